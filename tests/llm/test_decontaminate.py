import itertools
import random
import re

import numpy as np
from itemforge.llm.decontaminate import MASKS, PART, SHORT_ITEM, SUBSTITUTIONS, WINDOW, find_contamination, remove_contaminated

WORDS = [f"w{i}" for i in range(5000)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def brute(a, b):
    """Whether some aligned window of both differs in few places: all diagonals are tried."""
    a, b = re.findall(r"\w+", (a or "").lower()), re.findall(r"\w+", (b or "").lower())
    if not a or not b:
        return False
    code = {w: i for i, w in enumerate({*a, *b})}
    x = np.full(len(a) + 2 * WINDOW, -1)
    x[WINDOW:-WINDOW] = [code[w] for w in a]
    y = np.full(len(b) + 2 * WINDOW, -2)
    y[WINDOW:-WINDOW] = [code[w] for w in b]
    same = (x[:, None] == y[None]).astype(int)
    n, m = same.shape
    windows = sum(same[k : n - WINDOW + 1 + k, k : m - WINDOW + 1 + k] for k in range(WINDOW))
    w = min(WINDOW, len(b))
    return bool(windows.max() >= w - (0 if w < SHORT_ITEM else SUBSTITUTIONS * w // WINDOW))


def test_masks_hold_for_all_substitutions():
    for bad in itertools.combinations(range(WINDOW), SUBSTITUTIONS):
        assert any(not {s + k for k in m} & set(bad) for m in MASKS for s in range(WINDOW - m[-1]))


def test_substituted_passages_are_found_and_others_not(spark):
    rng = random.Random(1)
    items = [(i, text(rng, n)) for i, n in enumerate([40, 13, 25, 60, 5])] + [(9, None)]
    docs, want = [], set()
    for d in range(60):
        body = text(rng, rng.randint(0, 60)).split()
        if d % 3 == 0:
            item, passage = items[d % 4]
            words = passage.split()
            at = rng.randint(0, len(words) - WINDOW)
            part = words[at : at + WINDOW]
            for k in rng.sample(range(WINDOW), d % 5):
                part[k] = "zz" + str(k)
            body[10:10] = part
        docs.append((d, " ".join(body), "x"))
    docs += [(100, None, "x"), (None, items[0][1].upper(), "x"), (101, "", "x"), (102, items[3][1], "x"), (102, items[3][1], "x")]
    want = {(d, i) for d, t, _ in docs for i, b in items if b and brute(t, b)}
    got = find_contamination(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(repr, [(r.doc_id, r.item_id) for r in got.collect()])) == sorted(map(repr, want))
    assert {(0, 0), (None, 0), (102, 3)} <= want


def test_parts_hold_for_all_substitutions():
    """Items of 9 to 12 tokens may differ in two: some part that begins near enough to the start stays whole."""
    for n in range(SHORT_ITEM, WINDOW):
        for bad in itertools.combinations(range(n), SUBSTITUTIONS * n // WINDOW):
            assert any(not set(range(s, s + PART)) & set(bad) for s in range(WINDOW - 6 + 1) if s + PART <= n)


def test_short_items(spark):
    """Items of 1 to 8 tokens are found as a whole, those of 9 to 12 with two substitutions anywhere."""
    rng = random.Random(4)
    items = [(n, " ".join(f"q{n}x{k}" for k in range(n))) for n in range(1, 13)]
    docs, d = [], 0
    for n, t in items:
        for bad in itertools.combinations(range(n), 1 if n < 9 else 2):
            w = t.split()
            for k in bad:
                w[k] = "zz"
            docs.append((d, " ".join([text(rng, 3), *w, text(rng, 2)]), "x"))
            docs.append((d + 1, " ".join(w), "x"))
            d += 2
        docs += [(d, f"a {t} b", "x"), (d + 1, t, "x")]
        d += 2
    docs += [(d, "q1x0", "x"), (d + 1, "", "x"), (d + 2, None, "x"), (d + 3, "other " * 50000 + items[2][1], "x")]
    want = {(i, n) for i, t, _ in docs[:-1] for n, b in items if brute(t, b)} | {(d + 3, 3)}
    got = find_contamination(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_empty_tables_and_removal(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n", 7), (2, None, 8), (None, "x", 9)], "doc_id long, text string, seed int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(docs, none).count() == 0
    assert find_contamination(docs.limit(0), none).count() == 0
    items = spark.createDataFrame([(1, "A, b. c d e f g h i j k l m n")], "item_id long, text string")
    kept = remove_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.seed for r in kept.collect()) == [8, 9]
