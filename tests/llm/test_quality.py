import re
import unicodedata
import zlib

import numpy as np
from itemforge.llm import quality
from itemforge.llm.quality import QualityModel, Rule, fit_quality, fit_rules, rate_quality, score_quality, statistics
from pyspark.sql import functions as F

DOCS, LABELS = "doc_id long, text string, chars string, score string", "doc_id long, quality int, text string"


def plain(t):
    """The statistics of a text by loops over its characters."""
    t = t or ""
    cat = [unicodedata.category(c) for c in t]
    space = [c in "\t\n\x0b\x0c\r" or k[0] == "Z" for c, k in zip(t, cat)]
    sign = [not s and k[0] not in "LMN" for s, k in zip(space, cat)]
    words, word = [], ""
    for c, s in zip(t + " ", space + [True]):
        if s:
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    lines = [x for x, y in ((x, x.strip("\t\x0b\x0c\r   ")) for x in t.split("\n")) if y]
    letters = sum(k[0] == "L" for k in cat)
    at = lambda xs, i, d: xs[i] if 0 <= i < len(t) else d
    share = lambda a, b: a / b if b else 0.0
    n = len(words)
    return {
        "chars": np.log1p(len(t)),
        "letters": share(letters, len(t)),
        "capitals": share(cat.count("Lu"), letters),
        "digits": share(cat.count("Nd"), len(t)),
        "symbols": share(sum(s and c not in ".,;:'()-" for s, c in zip(sign, t)), n),
        "sign_runs": share(sum(s and (at(sign, i - 1, False) or at(sign, i + 1, False)) for i, s in enumerate(sign)), n),
        "lone_signs": share(sum(s and at(space, i - 1, True) and at(space, i + 1, True) for i, s in enumerate(sign)), n),
        "stops": share(sum(c in ".?" and i > 0 and cat[i - 1][0] == "L" and at(space, i + 1, True) for i, c in enumerate(t)), n),
        "word_length": share(letters, n),
        "distinct_words": share(len(set(words)), n),
        "distinct_lines": share(len(set(lines)), len(lines)),
        "line_words": share(n, len(lines)),
    }


def test_statistics_equal_plain_loops():
    rng = np.random.default_rng(0)
    marks = ["a", "B", "é", "日", "3", " ", "  ", "\n", "\n\n", ".", "?", "!", "***", "|", " ", "́", "😀", ",", "\x00"]
    texts = ["".join(marks[k] for k in rng.integers(0, len(marks), rng.integers(0, 60))) for _ in range(300)] + [None, "", "\n", "same\nsame", "x" * 50000]
    got = statistics(texts)
    for t, row in zip(texts, got):
        want = plain(t)
        assert np.allclose(row, [want[s] for s in quality.STATISTICS]), (t, dict(zip(quality.STATISTICS, row)), want)


def test_held_out_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    got = rate_quality(docs, labels).collect()
    assert len(got) == docs.count()
    assert {r.doc_id for r in got if r.held_out} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    label = {r.doc_id: r.quality for r in labels.collect()}
    right = [r.predicted == label[r.doc_id] for r in got if r.held_out and r.doc_id in label]
    assert np.mean(right) > 0.9


def test_labels_of_held_out_rows_and_other_columns_are_not_used(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = fit_quality(docs, labels)
    turned = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string"))
    assert fit_quality(other, turned) == model


def test_columns_equal_the_rules_in_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 1] <= 0.6)).astype(float)
    names = ["a", "b", "c"]
    model = fit_rules(x, y, np.ones(400), names)
    z = model.bias + sum(r.weight * r.holds(x, names) for r in model.rules)
    assert np.mean((z > 0) == y) > 0.98
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, a double, b double, c double")
    got = [r.s for r in df.select("i", model.score({n: F.col(n) for n in names}).alias("s")).orderBy("i").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-z)))


def test_trees_give_paths_and_lasso_keeps_few():
    rng = np.random.default_rng(2)
    x = rng.random((600, 4))
    y = (x[:, 2] > 0.5).astype(float)
    rules = quality.tree_rules(x, y, np.ones(600), list("abcd"))
    assert len(set(rules)) == len(rules) and all(1 <= len(r.conditions) <= 3 for r in rules)
    m = np.stack([r.holds(x, list("abcd")) for r in rules], 1).astype(float)
    assert all(quality.LEAST_ROWS <= c <= 600 for c in m.sum(0))
    few, many = (np.count_nonzero(np.abs(quality.lasso(m, y, np.ones(600), p)[1]) > 1e-6) for p in (0.05, 0.0001))
    assert 0 < few < many
    assert np.count_nonzero(quality.lasso(m, y, np.ones(600), 10.0)[1]) == 0


def test_odd_rows(spark):
    good, bad = "A plain line of text. And one more here.", "### !! $$$ ### !! ### $$$"
    rows = [(i, (good if i % 3 else bad) + f" {'word ' * (i % 5)}", "c", "s") for i in range(200)]
    odd = [(900, None, "c", "s"), (901, "", "c", "s"), (None, good, "c", "s"), (5, good, "c", "s"), (5, good, "c", "s"), (902, good * 30000, "c", "s")]
    docs = spark.createDataFrame(rows + odd, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "t") for i in range(200)] + [(3, 1, "t"), (4, None, "t"), (None, 0, "t"), (900, 1, "t")], LABELS)
    got = rate_quality(docs, labels).collect()
    assert len(got) == len(rows + odd)
    by = {r.doc_id: r for r in got}
    assert by[900].score == by[901].score and not by[None].held_out
    assert by[None].predicted == 1 and by[902].doc_id == 902
    assert np.mean([by[i].predicted == int(i % 3 > 0) for i in range(200) if i != 5]) > 0.95
    assert rate_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in rate_quality(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in rate_quality(docs, labels.where("quality = 1")).collect()} == {0.0}


def test_a_model_without_rules(spark):
    got = score_quality(spark.createDataFrame([(1, "x", "c", "s")], DOCS), QualityModel(0.0)).first()
    assert got.score == 0.5 and got.n_rules == 0
    assert str(Rule((("chars", True, 1.5), ("stops", False, 0.25)))) == "chars > 1.5 and stops <= 0.25"
    assert re.match(r"\w", str(Rule((("chars", True, 1.0),))))
