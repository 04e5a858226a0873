import random
import re

import numpy as np
from itemforge.llm.linededup import HOLE, SHORT, WHOLE, dedup_lines, drop_repeated_lines, variant_hashes

DOCS = "doc_id long, text string, n_chars long, place string, n_lines string"


def words(line):
    return tuple(re.sub(r"([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff])", r" \1 ", line).lower().split())


def brute(docs, min_words=1, fuzzy=8):
    """Which line numbers of which documents go."""
    rows = [(-1 if d is None else d, j, words(x)) for d, t in docs if t is not None for j, x in enumerate(t.split("\n"))]
    first = {}
    for d, j, w in sorted(rows, key=lambda r: r[:2]):
        if len(w) >= min_words:
            first.setdefault(w, (d, j))

    def one_apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = max(a, b, key=len), min(a, b, key=len)
        return len(a) - len(b) == 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))

    near = {w for w, o in first.items() if len(w) >= fuzzy and any(p < o and len(v) >= fuzzy and one_apart(w, v) for v, p in first.items())}
    return {(d, j) for d, j, w in rows if len(w) >= min_words and (w in near or first[w] < (d, j))}


def test_equals_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randint(1, 14))) for _ in range(30)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            w = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], ["zz"], [w[k], "yy"]]) or (["zz"] if len(w) == 1 else [])
            lines.append((" " * rng.randint(0, 2)).join(["", *w]) if rng.random() < 0.3 else " ".join(w).title())
        docs.append((d, "\n".join(lines)))
    han = "日本語の文章には空白がありません"
    docs += [(100, han + "\nok\n\nแปด"), (101, han.replace("文", "本") + "\n " + han[:4]), (102, han[:4] + "\nOK\nแปด\n")]
    docs += [(200, None), (201, ""), (None, docs[5][1])]
    rows = spark.createDataFrame([(d, t, 0, "p", "q") for d, t in docs], DOCS)
    gone = brute(docs)
    got = {-1 if r.doc_id is None else r.doc_id: r for r in dedup_lines(rows).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        d = -1 if d is None else d
        want = None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (d, j) not in gone)
        assert got[d].text == want, d
        assert got[d].n_removed == sum(g[0] == d for g in gone)


def test_variants_meet_exactly_when_one_word_apart():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 62, 9).astype(np.uint64)
    other, longer = a.copy(), np.insert(a, 4, np.uint64(7))
    other[3] = 5
    twice = other.copy()
    twice[7] = 5
    lines = [a, other, longer, twice]
    offsets = np.cumsum([0, *map(len, lines)])
    line, role, key = variant_hashes(np.concatenate(lines), offsets)

    def keys(i, r):
        return set(key[(line == i) & (role == r)].tolist())

    assert len(keys(0, HOLE) & keys(1, HOLE)) == 1 and not keys(0, HOLE) & keys(3, HOLE)
    assert keys(0, WHOLE) <= keys(2, SHORT) and not keys(0, HOLE) & keys(2, HOLE)


def test_whole_documents_go_and_columns_stay(spark):
    rows = spark.createDataFrame([(1, "one two three\nfour five six", 27, "p", "q"), (2, "One  two three", 14, "p", "q"), (3, None, None, "p", "q"), (4, "", 0, "p", "q")], DOCS)
    out = drop_repeated_lines(rows)
    assert out.columns == rows.columns
    assert sorted((r.doc_id, r.n_chars) for r in out.collect() if r.doc_id != 3) == [(1, 27), (4, 0)]
    assert dedup_lines(rows.limit(0)).count() == 0
    again = spark.createDataFrame([(1, "same words here", 1, "", "")] * 2, DOCS)
    assert [r.text for r in dedup_lines(again).collect()] == ["same words here"] * 2  # equally early


def test_a_very_long_line(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    rows = spark.createDataFrame([(1, long, 0, "", ""), (2, long.replace("w777 ", "x "), 0, "", ""), (3, "short line here", 0, "", "")], DOCS)
    assert sorted((r.doc_id, r.n_removed) for r in dedup_lines(rows).collect()) == [(1, 0), (2, 1), (3, 0)]


def test_rows_that_share_an_id_are_apart(spark):
    line = "a b c d e f g h i j"
    rows = [(1, "alpha beta gamma"), (3, "alpha beta gamma"), (3, "unique other words"), (7, "sevens line\nrest one"), (7, "sevens line\nrest two")]
    rows += [(None, "first words here"), (None, "others stand here\nfirst words here")]
    rows += [(0, line), (5, line.replace("c", "x")), (5, "k l m n o p q r s t")]
    rows = spark.createDataFrame([(i, t, 0, "p", "q") for i, t in rows], DOCS)
    got = sorted((repr(r.doc_id), r.text) for r in dedup_lines(rows).collect())
    known = [g for g in got if g[0] not in ("None", "7")]
    assert known == sorted([("0", line), ("1", "alpha beta gamma"), ("3", ""), ("3", "unique other words"), ("5", ""), ("5", "k l m n o p q r s t")])
    # A hash of the text says which of two rows is earlier; one copy of each line stays.
    assert sorted(x for i, t in got if i == "None" for x in t.split("\n") if x) == ["first words here", "others stand here"]
    assert sorted(x for i, t in got if i == "7" for x in t.split("\n")) == ["rest one", "rest two", "sevens line"]
    # Two rows lost all they had; of those without id it may be a third.
    assert drop_repeated_lines(rows).count() == 10 - sum(t == "" for _, t in got)
