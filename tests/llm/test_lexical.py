import math
import random
import re
from collections import Counter

import pytest
from itemforge.llm import lexical
from itemforge.llm.lexical import search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string, row string, term string", "item_id long, text string, n string"


def brute(docs, items, k=10):
    counted = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t, *_ in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text, *_ in items:
        scores = []
        for i, c, n in counted:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            s = 0
            for t in set(TERM.findall((text or "").translate(LOW))) & set(c):
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        out += [(item, r, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def corpus():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    often = ["the", "of", "and", "Ünd", "日本"]
    text = lambda n: " ".join(rng.choice(often) if rng.random() < 0.5 else rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(1, 60)), "r", "t") for i in range(300)]
    docs += [(1000 + i, "copied text of the w1 w2 w3 w4", "r", "t") for i in range(150)]  # a third are copies: ties at the bar
    docs += [(2000, None, "r", "t"), (2001, "", "r", "t"), (2002, "?!\x00", "r", "t"), (None, "copied text w7", "r", "t"), (7, "the the THE tHe ÜND", "r", "t"), (7, "the the THE tHe ÜND", "r", "t"), (2003, "w9 of " * 60000, "r", "t")]
    items = [(i, text(rng.randint(1, 30)), "n") for i in range(25)] + [(50, None, "n"), (51, "", "n"), (52, "unknown zzz", "n"), (53, "w1 W1 w1 copied", "n"), (None, "w9 the", "n"), (54, "ünd Ünd", "n"), (54, "the", "n")]
    return docs, items


@pytest.mark.parametrize("tiers", [lexical.TIERS, (5, 40), (0, 0), (30,)])
def test_equals_brute_force(spark, tiers):
    docs, items = corpus()
    got = search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), tiers=tiers).collect()
    assert key(got) == key(brute(docs, items))


def test_items_fall_through_the_tiers(spark, monkeypatch):
    """Each way is taken: some items are proven by the first tier, some by the second, some by none."""
    docs, items = corpus()
    proven, last = [], []
    answer, rest = lexical.answer, lexical._last
    monkeypatch.setattr(lexical, "answer", lambda *a: proven.append(lexical.materialize(answer(*a), "t")) or proven[-1])
    monkeypatch.setattr(lexical, "_last", lambda left, *a: last.append(left.select("item").distinct().count()) or rest(left, *a))
    search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k=2, tiers=(4, 40)).collect()
    assert [x.select("item").distinct().count() > 0 for x in proven] == [True, True] and last[0] > 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 20)
    monkeypatch.setattr(lexical, "CELLS", 50)
    docs, items = corpus()
    got = search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), tiers=(0,)).collect()
    assert key(got) == key(brute(docs, items))


def test_empty_tables(spark):
    docs, items = corpus()
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert search(no_docs, spark.createDataFrame(items, ITEMS)).count() == 0
    assert search(spark.createDataFrame(docs, DOCS), no_items).count() == 0
    assert search(no_docs, no_items).count() == 0


def test_terms():
    texts = ["Ab-cD é9_x\x00y", None, "", "ÀÉ 日本語。", "a" * 70000]
    words, text = terms_of(texts)
    got = [[w.decode() for w, k in zip(words.to_pylist(), text) if k == i] for i in range(len(texts))]
    assert got == [TERM.findall((t or "").translate(LOW)) for t in texts]
