import re

import corpus_pipeline
from itemforge.llm import queries
from itemforge.llm.common import materialize

from .test_decontaminate import brute as overlaps
from .test_jaccard import brute as classes
from .test_linededup import brute as repeated


def test_each_stage_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, sf_dir).persist()
        after = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            want = {i: t for i, t in before.items() if t and any(map(str.isalpha, t))}
        elif name == "line_dedup":
            gone = repeated(list(before.items()))
            cut = {i: "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone) for i, t in before.items()}
            want = {i: t for i, t in cut.items() if t == before[i] or re.search(r"\w", t)}
        elif name == "jaccard_join":
            found = classes(list(before.items()))
            want = {i: t for i, t in before.items() if found[i][0] == i}
        elif name == "decontamination":
            seeds = [b for b in bench if len(re.findall(r"\w+", b)) >= 9]
            want = {i: t for i, t in before.items() if not any(overlaps(t, b) for b in seeds)}
        else:
            assert set(after) == set(before) and all(r.n_tokens == len(r.ids) for r in after.values())
            continue
        assert docs.columns == columns
        assert {i: r.text for i, r in after.items()} == want, name


def test_queries_are_registered():
    assert {int(k[2:].split("_")[0]) for k in queries.QUERIES} == set(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


ODD = "doc_id long, text string, lang string, source string, n_chars long, _lines string, _cut int, _row long, row string, node string, _bad int, score string, kept_text int"
LINE = "one two three four five six seven eight nine ten"


def odd_rows(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    rows = [
        (1, LINE, "en"), (2, None, "en"), (3, "", "en"), (4, "123 !!", None),  # no letters: language ID drops 2 to 4
        (5, "first words of a row\nand more of it here", "en"), (5, "another text under the same id as before", "en"), (None, "a row without any id stands here", "en"), (None, "another row without an id as well", "en"),
        (6, LINE, "en"),  # repeats 1: line dedup leaves nothing of it
        (7, f"it holds an item {item}", "en"),  # decontamination drops it
        (8, "word " * 60000, "en"), (9, "x" * 300000, "en"),  # very long, with and without white space
    ]
    return spark.createDataFrame([(i, t, lang, "s", 0, "a", 1, 2, "b", "c", 3, "d", 4) for i, t, lang in rows], ODD)


def test_stages_with_odd_rows(spark, sf_dir):
    docs = odd_rows(spark, sf_dir)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, materialize(stage(spark, docs, sf_dir), "odd")
        assert docs.columns == columns, name
        assert docs.where("_lines = 'a' and _cut = 1 and _row = 2 and row = 'b' and node = 'c' and _bad = 3 and score = 'd' and kept_text = 4").count() == docs.count(), name
    got = sorted((repr(r.doc_id), r.text[:12]) for r in docs.collect())
    assert got == sorted([("1", LINE[:12]), ("5", "first words "), ("5", "another text"), ("None", "a row withou"), ("None", "another row "), ("8", "word word wo"), ("9", "x" * 12)])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == 7 and last.where("n_tokens = size(ids)").count() == 7


def test_stages_with_no_rows(spark, sf_dir):
    docs = odd_rows(spark, sf_dir).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "none")
        assert docs.count() == 0
