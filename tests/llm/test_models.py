import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from itemforge.llm.langid import codewords, identify_languages, keep_known_languages
from itemforge.llm.shard import shard_stratified
from itemforge.llm import langid, toxicity
from itemforge.llm.toxicity import ToxicModel, detect_toxicity, fit_toxicity, marginals, score_toxicity
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, score string"


def test_code_words_are_apart():
    for n in (1, 2, 4, 5, 9):
        code = codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == n


def test_languages_of_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = identify_languages(docs).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_decoding_equals_plain_loops(spark):
    """Every prediction from the model's weights by loops over bits and languages."""
    words = {"en": "the cat and the dog", "fr": "le chat et le chien", "de": "die katze und der hund"}
    docs = [(i, f"{t} {i}", lang, "s", "x") for i, (lang, t) in enumerate(list(words.items()) * 15)]
    df = spark.createDataFrame(docs, DOCS)
    model = langid.fit_languages(df)
    got = {r.doc_id: r for r in langid.predict_languages(df, model).collect()}
    for i, t, *_ in docs:
        x = langid.features(t)
        loss = []
        for k in range(len(model.languages)):
            total = 0.0
            for b in range(model.code.shape[1]):
                margin = sum(float(v) * float(model.weights[j, b]) for j, v in enumerate(x) if v) + float(model.bias[b])
                total += np.log1p(np.exp(-model.code[k, b] * margin))
            loss.append(total)
        order = np.argsort(loss)
        p = np.exp(-model.scale * (np.array(loss) - min(loss)))
        assert (got[i].lang_pred, got[i].lang_second) == tuple(model.languages[k] for k in order[:2])
        assert abs(got[i].score - p[order[0]] / p.sum()) < 1e-3


def test_languages_edge_cases(spark):
    rows = [(i, t, lang, "s", "x") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)]
    odd = [(100, None, "en", "s", "x"), (101, "", "en", "s", "x"), (102, "123 !!", "fr", "s", "x"), (None, "the dog", None, "s", "x"), (5, "the dog and the cat", "en", "s", "x"), (103, "the " * 400000, None, "s", "x")]
    docs = spark.createDataFrame(rows + odd, DOCS)
    got = identify_languages(docs).collect()
    assert len(got) == len(rows + odd)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[None].lang_pred == "en" and by[103].lang_pred == "en"
    kept = keep_known_languages(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows + odd) - 3
    unlabelled = spark.createDataFrame([(1, "word", None, "s", "x"), (2, "1", None, "s", "x")], DOCS)
    assert [r.doc_id for r in keep_known_languages(unlabelled).collect()] == [1]
    assert identify_languages(docs.limit(0)).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 1, 4])
    e, start, trans = rng.standard_normal(8), 0.3, rng.standard_normal((2, 2))
    got = marginals(e, np.cumsum(lengths) - lengths, lengths, start, trans)
    at = 0
    for n in lengths:
        total = np.zeros(n)
        z = 0.0
        for state in np.ndindex(*[2] * n):
            s = sum(e[at + k] * v for k, v in enumerate(state)) + start * state[0] + sum(trans[a, b] for a, b in zip(state, state[1:]))
            z += np.exp(s)
            total += np.exp(s) * np.array(state)
        assert np.allclose(got[at : at + n], total / z)
        at += n


def test_pair_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([2, 1, 5])
    e, start, trans = rng.standard_normal(8), -0.4, rng.standard_normal((2, 2))
    starts = np.cumsum(lengths) - lengths
    at = np.array([k for k in range(8) if k not in starts])
    got = toxicity._pairs(e, starts, lengths, start, trans, at)
    for a, n in zip(starts, lengths):
        states = [(s, np.exp(sum(e[a + k] * v for k, v in enumerate(s)) + start * s[0] + sum(trans[x, y] for x, y in zip(s, s[1:])))) for s in np.ndindex(*[2] * n)]
        z = sum(w for _, w in states)
        for k in range(1, n):
            want = [sum(w for s, w in states if (s[k - 1], s[k]) == pair) / z for pair in ((0, 0), (0, 1), (1, 0), (1, 1))]
            assert np.allclose(got[list(at).index(a + k)], want)


def test_field_fits_its_chains():
    """On separable chains the fitted field gives back the labels."""
    chains = [(["good", "vile", "day"], [0, 1, 0]), (["vile"], [1]), (["good", "day"], [0, 0])]
    weights, bias, start, trans = toxicity._fit_field(chains)
    model = ToxicModel(weights, bias, start, trans, np.zeros(4))
    p = toxicity.tag(toxicity.tokens(pa.array(["good vile day\nvile", "good day"])), model)
    assert [(x > 0.5).tolist() for x in p] == [[False, True, False, True], [False, False]]


def test_aggregates_equal_enumeration():
    p = np.array([0.1, 0.7, 0.4])
    none = sum(np.prod([(1 - q, q)[v] for q, v in zip(p, s)]) for s in np.ndindex(2, 2, 2) if not any(s))
    assert np.allclose(toxicity.aggregates(p), [np.log(1 + 1.2), 0.7, 1 - none])
    assert toxicity.aggregates(np.zeros(0)).tolist() == [0, 0, 0]


def test_tokens_and_spans_equal_brute_force():
    rng = np.random.default_rng(2)
    marks = ["a", "é", "日本", " ", "  ", "\n", "\t", "\u00a0", "b", "😀", "\u2003"]
    texts = ["".join(marks[k] for k in rng.integers(0, len(marks), rng.integers(0, 40))) for _ in range(300)] + ["", "\n\n", "x" * 50000]
    got = toxicity.tokens(pa.array(texts))
    assert [got.of(k) for k in range(len(texts))] == [t.split() for t in texts]
    assert got.chains.tolist() == [len(ln.split()) for t in texts for ln in t.split("\n") if ln.split()]
    assert [a for a, _ in toxicity.slices(pa.array(texts), 50)][0] == 0
    assert [x for _, part in toxicity.slices(pa.array(texts), 50) for x in part.to_pylist()] == texts
    for k, t in enumerate(texts):
        words = t.split()
        p = rng.random(len(words))
        toxic = set()  # offsets of letters in toxic tokens, and of the blanks between two of one line
        at, before = 0, None
        for w, q in zip(words, p):
            a = t.index(w, at)
            at = a + len(w)
            if q >= 0.5:
                toxic |= set(range(a, at)) | (set(range(before, a)) if before is not None and "\n" not in t[before:a] else set())
            before = at if q >= 0.5 else None
        want = [i for i in sorted(toxic) if i - 1 not in toxic]
        found = toxicity.spans(t, words, p)
        assert [a for a, _ in found] == want and {i for a, b in found for i in range(a, b)} == toxic


def test_toxicity_of_held_out_rows(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in detect_toxicity(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.9
    assert all(r.predicted == (r.score >= 0.5) for r in held)


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "", "", ""), (2, "", "", "", ""), (None, "a b", "", "", ""), (3, "x", "", "", ""), (3, "x", "", "", "")], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = detect_toxicity(docs, none).collect()
    assert len(got) == 5 and all(r.score == 0 for r in got)
    assert detect_toxicity(docs.limit(0), none).count() == 0


def test_toxicity_is_the_same_each_time(spark):
    """Copies of a text with other ids and labels, and ids with two texts, don't let the sample change."""
    docs = [(i, f"plain words number {i % 50} " + ("vilest thing" if i % 2 else "kind thing"), "", "", "") for i in range(200)]
    docs += [(i + 1000, t, *rest) for i, t, *rest in docs] + [(3, "other text", "", "", ""), (3, None, "", "", "")]
    labels = [(i, 0, i % 2) for i in range(200)] + [(i + 1000, 0, (i + 1) % 2) for i in range(200)] + [(3, 0, 0), (None, 0, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(docs, DOCS)
    a, b = fit_toxicity(docs, labels), fit_toxicity(docs.repartition(7).orderBy(F.desc("text")), labels.repartition(3))
    assert (a.weights == b.weights).all() and np.allclose(a.doc, b.doc)


def test_toxicity_is_learned_from_long_lines(spark):
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(160):
        w = [f"w{k}" for k in rng.integers(0, 400, 600)]
        if i % 2:
            for k in rng.integers(250, 600, 12):
                w[k] = "vilest"
        docs.append((i, " ".join(w), "", "", ""))
        labels.append((i, 0, i % 2))
    docs, labels = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert all(r.predicted == r.doc_id % 2 for r in detect_toxicity(docs, labels).collect())
    blank = docs.withColumn("text", F.concat(F.lit(" "), F.repeat(F.lit("\n"), F.col("doc_id").cast("int"))))
    with pytest.raises(ValueError, match="no token"):
        fit_toxicity(blank, labels)
    assert score_toxicity(docs, None).where("score <> 0").count() == 0


def test_shards_equal_a_plain_loop(spark):
    docs = [(i, "t" * (i % 13), "en", None if i % 11 == 0 else f"s{i % 3 if i % 2 else 0}", "x") for i in range(777)]
    of = {}
    for i, _, _, source, _ in docs:
        of.setdefault(source, []).append((hashlib.md5(f"0:{i}".encode()).hexdigest(), i))
    line = []
    for source, own in of.items():
        for rank, (h, i) in enumerate(sorted(own)):
            line.append(((rank + 0.5) / len(own), source is not None, source or "", h, i))
    line.sort()
    want = {}
    for place, (*_, i) in enumerate(line):
        shard = place * 24 // len(docs)
        want[i] = (shard, place - next(p for p in range(len(docs)) if p * 24 // len(docs) == shard))
    got = shard_stratified(spark.createDataFrame(docs, DOCS), 24).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want


@pytest.mark.parametrize("rows", [0, 1, 23, 24, 500])
def test_shards(spark, rows):
    docs = [(i, f"t{i}" if i % 7 else None, "en", None if i % 11 == 0 else f"s{i % 3 if i % 2 else 0}", "x") for i in range(rows)]
    got = shard_stratified(spark.createDataFrame(docs, DOCS), 24).collect()
    assert len(got) == rows
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r)
        t = dict((d[0], d[1]) for d in docs)[r.doc_id] or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 8, zlib.crc32(t.encode()), "rows", None)
    if rows:
        sizes = [len(per.get(k, ())) for k in range(24)]
        assert max(sizes) - min(sizes) <= 1
        assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in per.values())
    if rows == 500:  # each shard has the mixture
        whole = sum(d[3] == "s0" for d in docs) / rows
        assert all(abs(sum(r.source == "s0" for r in v) - whole * len(v)) <= 2 for v in per.values())
