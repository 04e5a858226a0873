import re
import time

import pytest
from itemforge import schema
from itemforge.functions import text as t
from itemforge.operators import assemble, bank, export, validate, views
from itemforge.sources import files
from pyspark.sql import functions as F

DOCS = "hash string, file string, kind string, title string, discipline string, topic string"
OPTIONS = [("A", "x"), ("B", "y")]


def payload(spark, rows):
    full = [(h, n, f"t{n}", None, y, "d", "t", s, "Fixação", 1, "text", OPTIONS, "A", 1, False, None) for h, n, y, s in rows]
    return spark.createDataFrame(full, schema.QUESTION.replace(", published BOOLEAN, created TIMESTAMP", ""))


@pytest.fixture
def store(spark, tmp_path):
    return bank.BankStore(spark, f"file://{tmp_path}/bank")


def tables(store):
    return {n: sorted(map(repr, store.read(n, s).collect())) for n, s in (("imports", schema.IMPORT), ("questions", schema.QUESTION), ("lists", schema.LIST), ("members", schema.MEMBER))}


def test_the_same_import_twice_changes_nothing(spark, store):
    docs = spark.createDataFrame([("h1", "a.pdf", None, "T", "d", "t")], DOCS)
    p = payload(spark, [("h1", 1, 2000, ["b", "a"]), ("h1", 2, None, ["a", "c"])])
    day = F.lit("2026-01-01").cast("timestamp")
    assert bank.import_documents(store, docs, p, day) == 1
    first = tables(store)
    assert bank.import_documents(store, docs, p, day) == 2
    assert tables(store) == first
    assert store.read("lists", schema.LIST).first().tags == ["b", "a", "c"]
    assert store.read("imports", schema.IMPORT).first().kind == "lista"


def test_a_null_overwrites_and_flags_stay(spark, store):
    docs = spark.createDataFrame([("h1", "a.pdf", "lista", "T", "d", "t")], DOCS)
    bank.import_documents(store, docs, payload(spark, [("h1", 1, 2000, ["a"])]))
    published = store.read("questions", schema.QUESTION).withColumn("published", F.lit(True))
    named = store.read("lists", schema.LIST).withColumn("name", F.lit("my name"))
    store.commit({"questions": published, "lists": named, "imports": store.read("imports", schema.IMPORT), "members": store.read("members", schema.MEMBER)})
    bank.import_documents(store, docs.withColumn("topic", F.lit("new")), payload(spark, [("h1", 1, None, ["z"])]))
    q, own = store.read("questions", schema.QUESTION).first(), store.read("lists", schema.LIST).first()
    assert q.year is None and q.published and (own.name, own.topic, own.tags) == ("my name", "new", ["z"])


def test_an_import_that_drops_a_question_changes_nothing(spark, store):
    docs = spark.createDataFrame([("h1", "a.pdf", "lista", "T", "d", "t")], DOCS)
    bank.import_documents(store, docs, payload(spark, [("h1", 1, 2000, ["a"]), ("h1", 2, 2000, ["a"])]))
    before = tables(store)
    with pytest.raises(Exception, match="would drop stored questions"):
        bank.import_documents(store, docs, payload(spark, [("h1", 1, 2000, ["a"]), ("h1", None, 1, [])]))
    assert store.version() == 1 and tables(store) == before


def test_saving_a_list(spark):
    questions = spark.createDataFrame([("h", 1), ("h", 2), ("g", 1)], "hash string, number int")
    members = spark.createDataFrame([("L", "h", 2, 1), ("M", "g", 1, 1)], schema.MEMBER)
    ask = spark.createDataFrame([("L", "g", 1, 1), ("L", "h", 1, 2), ("L", "g", 1, 3)], "list_id string, hash string, number int, ord int")
    got = bank.save_list(members, ask, questions).collect()
    assert sorted(map(tuple, got)) == [("L", "g", 1, 1), ("L", "h", 1, 2), ("M", "g", 1, 1)]
    with pytest.raises(Exception, match="not in the bank: x/9"):
        bank.save_list(members, spark.createDataFrame([("L", "x", 9, 1)], ask.schema), questions).collect()
    assert [tuple(r) for r in bank.removed_members(members, ask).collect()] == [("L", "h", 2, 1)]


def test_lists_change_by_what_is_given(spark):
    lists = spark.createDataFrame([("L", "n", "x", "d", "t", ["a"], "rascunho", "h", None, None), ("M", "m", None, None, None, [], "rascunho", None, None, None)], schema.LIST)
    change = spark.createDataFrame([("L", {"name": "new", "topic": None})], "list_id string, given map<string,string>")
    got = {r.list_id: r for r in bank.patch(lists, change).collect()}
    assert (got["L"].name, got["L"].topic, got["L"].description, got["M"].name) == ("new", None, "x", "m")
    ids = spark.createDataFrame([("L",)], "list_id string")
    assert {r.list_id: r.status for r in bank.publish(lists, ids).collect()} == {"L": "publicada", "M": "rascunho"}
    members = spark.createDataFrame([("L", "h", 2, 1), ("M", "g", 1, 1)], schema.MEMBER)
    left, rest = bank.delete_lists(lists, members, ids)
    assert [r.list_id for r in left.collect()] == ["M"] == [r.list_id for r in rest.collect()]
    with pytest.raises(Exception, match="a list needs a name"):
        bank.named(lists.withColumn("name", F.lit(" "))).collect()
    imports = spark.createDataFrame([("h", "f", "lista", "t", 1, None, None)], schema.IMPORT)
    none, orphans = bank.delete_imports(imports, lists, spark.createDataFrame([("h",)], "hash string"))
    assert none.count() == 0 and {r.hash for r in orphans.collect()} == {None}


def test_summaries_count_questions_not_issues(spark):
    lists = spark.createDataFrame([("L",), ("M",)], "list_id string")
    members = spark.createDataFrame([("L", "d", 1), ("L", "d", 2), ("L", "d", 9)], "list_id string, doc string, number int")
    rows = spark.createDataFrame([("d", 1, 3, 0), ("d", 2, 0, 1)], "doc string, number int, errors int, warnings int")
    got = {r.list_id: tuple(r)[1:] for r in views.list_summary(lists, members, rows, ["doc", "number"]).collect()}
    assert got == {"L": (2, 1, 1, 1), "M": (0, 0, 0, 0)}


def question(**changes):
    base = dict(doc="D", number=1, discipline="F", topic="T", subjects=["s"], stage="Fixação", difficulty=1, statement="text $x$", options=[("A", "one"), ("B", "two")], answer="A", review=False, notes=None, year=2000, figures=[], source_text="", outside=[])
    return tuple((base | changes).values())


QUESTION = "doc string, number int, discipline string, topic string, subjects array<string>, stage string, difficulty int, statement string, options array<struct<letter:string,text:string>>, answer string, review boolean, notes string, year int, figures array<struct<name:string,file:string,centred:boolean,table:boolean>>, source_text string, outside array<string>"


@pytest.mark.parametrize(
    ("change", "rules"),
    [
        ({}, []),
        ({"topic": "X", "subjects": ["X"]}, ["topic_not_of_list", "topic_unknown"]),
        ({"options": [("A", "one")]}, ["options_order"]),
        ({"options": [("A", "one"), ("C", "two")]}, ["options_order"]),
        ({"answer": "E"}, ["answer_not_an_option"]),
        ({"statement": "trecho ilegível"}, ["not_read"]),
        ({"options": [("A", " "), ("B", "b) two")]}, ["option_empty", "option_starts_with_letter"]),
        ({"difficulty": 3}, ["difficulty_outside_stage"]),
        ({"difficulty": 9, "stage": None}, ["difficulty_range"]),
        ({"subjects": []}, ["no_subject"]),
        ({"subjects": ["s", "z", "y"]}, ["subject_unknown", "subject_unknown"]),
        ({"statement": "a $ b ²"}, ["odd_dollars", "symbol_outside_math"]),
        ({"statement": "R$ 5 $x$ $"}, ["money_unescaped"]),
        ({"statement": "$\\frac{}{}$ $\\ce{x} {$"}, ["braces_unbalanced", "command_unsupported", "latex_incoherent"]),
        ({"statement": "![](figura:f1)"}, ["figure_unknown"]),
        ({"figures": [("f1", "", False, False)]}, ["figure_unused"]),
        ({"figures": [("t1", "", False, True)], "statement": "![](figura:t1)"}, ["table_as_figure"]),
        ({"figures": [("t1", "", False, True)]}, ["table_not_transcribed"]),
        ({"figures": [("t1", "", False, True)], "statement": "| a | b |"}, []),
        ({"source_text": "Questão 2 UFX 2000\ntext one two"}, ["cut_mixed"]),
        ({"source_text": "Questão 1 UFX 2000\n**forte** text one two"}, ["bold_lost", "words_missing"]),
        ({"source_text": "Questão 1 UFX 2000\ntext 123 one two"}, ["numbers_missing"]),
        ({"outside": ["stray"]}, ["content_outside"]),
        ({"review": True, "notes": "why"}, ["review_asked"]),
        ({"year": 1800}, ["year_range"]),
    ],
)
def test_each_rule(spark, change, rules):
    q = spark.createDataFrame([question(**change)], QUESTION)
    documents = spark.createDataFrame([("D", "lista", "F", "T")], "doc string, kind string, discipline string, topic string")
    topics = spark.createDataFrame([("F", "T", ["s"])], schema.TOPICS)
    assert sorted(r.rule for r in validate.validate(q, documents, topics).collect()) == sorted(rules)


def test_errors_block_and_warnings_unless_forced(spark):
    issues = spark.createDataFrame([("a", 1, "r", "E", "", ""), ("b", 1, "r", "W", "", "")], schema.ISSUE)
    assert {r.doc: r.blocked for r in validate.may_send(issues).collect()} == {"a": True, "b": True}
    assert {r.doc: r.blocked for r in validate.may_send(issues, force=True).collect()} == {"a": True, "b": False}


def test_topic_base(spark, tmp_path):
    (tmp_path / "base.txt").write_text("- lost\nDISCIPLINA: Física\n- Cinemática II: a; b ;\n- Solo\nDISCIPLINA: Artes\n- Solo: x's\n", encoding="utf-8")
    rows = files.read_topics(spark, f"file://{tmp_path}/base.txt")
    assert {(r.discipline, r.topic): r.subjects for r in rows.collect()} == {("Física", "Cinemática II"): ["a", "b"], ("Física", "Solo"): [], ("Artes", "Solo"): ["x's"]}
    assert "('Artes', 'Solo', ARRAY['x''s']::text[])" in {r.tuple for r in export.topic_tuples(rows).collect()}


def test_files_that_may_be_taken_in(spark, tmp_path):
    for name, content in (("a.pdf", b"%PDF-1"), ("b.PDF", b"%PDF"), ("c.pdf", b"text"), (".d.pdf", b"%PDF"), ("_e.pdf", b"%PDF"), ("f.txt", b"%PDF")):
        (tmp_path / name).write_bytes(content)
    assert sorted(r.file for r in files.read_documents(spark, f"file://{tmp_path}").collect()) == ["a.pdf", "b.PDF"]


def test_transcriptions_and_pieces(spark, tmp_path):
    (tmp_path / "doc 1" / "ia").mkdir(parents=True)
    (tmp_path / "doc 1" / "ia" / "Q01.json").write_text('{"numero": 1, "instituicao": null, "ano": 2012, "adaptada": false, "disciplina": "F", "topico": "T", "assuntos": ["s"], "dificuldade": 2, "enunciado": "e",\n "alternativas": [{"letra": "A", "texto": "x"}], "gabarito": "A", "revisar": false, "observacoes": null}')
    row = files.read_transcriptions(spark, f"file://{tmp_path}/*/ia/Q*.json").first()
    assert (row.doc, row.number, row.year, row.options[0].text) == ("doc 1", 1, 2012, "x")
    text = spark.createDataFrame([("k", "aGVsbG8=")], "k string, t string")
    pieces = text.select("k", F.posexplode(export.in_pieces(F.col("t"), 3)).alias("ord", "piece"))
    assert bytes(export.from_pieces(pieces, ["k"]).first().content) == b"hello"


def test_assembly_takes_the_official_answer(spark):
    cut = spark.createDataFrame([("D", 1, 1, "", "Questão 1 UFX 2014", "Fixação", [], []), ("D", 2, 1, "", "Questão 2", None, [], []), ("D", 3, 1, "", "", None, [], [])], schema.CUT_QUESTION)
    made = [("D", n, "USP", 2001, False, "d", "t", ["s"], 1, " text ", OPTIONS, "A", False, "note") for n in (1, 2)]
    documents = spark.createDataFrame([("D", "f.pdf", "h", "lista", "L", "d", "t", {"01": "B"})], schema.DOCUMENT)
    whole = assemble.assemble(cut, spark.createDataFrame(made, schema.TRANSCRIBED), documents)
    got = {r.number: r for r in whole.collect()}
    assert (got[1].answer, got[1].review, got[1].institution, got[1].year, got[1].statement) == ("B", True, "UFX", 2014, "text")
    assert got[1].notes == "note; transcription says A, official answer is B" and got[1].title == "Lista de Exercícios - L - Questão 01 - UFX 2014"
    assert (got[2].institution, got[2].problem, got[3].problem) == ("USP", "no official answer", "no transcription")
    good, bad = assemble.split_assembled(whole)
    assert (good.count(), bad.count()) == (1, 2)
    assert assemble.list_documents(good, documents).first().tags == ["s"]


def test_guards_hold_whatever_is_read(spark, store):
    members = spark.createDataFrame([], "list_id string, hash string, number int, position int")
    ask = spark.createDataFrame([("L", "x", 9, 1)], "list_id string, hash string, number int, ord int")
    questions = spark.createDataFrame([("x", 1)], "hash string, number int")
    wrong = spark.createDataFrame([("x", 1, "E")], "hash string, number int, severity string")
    placed = spark.createDataFrame([("L", "x", 1, 1)], "list_id string, hash string, number int, position int")
    blank = spark.createDataFrame([("L", None)], "list_id string, name string")
    for df in (bank.save_list(members, ask, questions), bank.guarded(questions.where("number > 5").unionByName(spark.createDataFrame([("x", 2)], "hash string, number int")), questions), bank.named(blank), bank.push_order(placed, wrong)):
        with pytest.raises(Exception, match="USER_RAISED|not in the bank|would drop|needs a name|with errors"):
            df.count()
        with pytest.raises(Exception, match="USER_RAISED|not in the bank|would drop|needs a name|with errors"):
            df.select(F.lit(1)).collect()


def test_two_writers_cant_follow_one_version(spark, store):
    rows = spark.createDataFrame([("a",)], "hash string")
    assert store.commit({"imports": rows}) == 1
    store.claim(1)
    with pytest.raises(RuntimeError, match="another writer follows version 1"):
        store.commit({"imports": rows})
    store.release(1)
    assert store.commit({"lists": rows}, base=1) == 2
    with pytest.raises(RuntimeError, match="another writer follows version 1"):
        store.commit({"imports": rows}, base=1)
    assert store.read("imports", "hash string").count() == 1 and store.version() == 2  # a table that wasn't given stays
    with pytest.raises(ZeroDivisionError):
        store.commit({"imports": Broken()})
    assert store.commit({"imports": rows}) == 3


class Broken:
    def __getattr__(self, name):
        raise ZeroDivisionError


def test_an_import_touches_its_buckets_only(spark, store):
    docs = spark.createDataFrame([(f"h{k}", "f.pdf", None, f"T{k}", "d", "t") for k in range(40)], DOCS)
    many = payload(spark, [(f"h{k}", n, 2000, ["a"]) for k in range(40) for n in (1, 2)])
    assert bank.import_documents(store, docs, many) == 1
    before = store._entries(1)
    assert bank.import_documents(store, docs.where("hash = 'h7'"), payload(spark, [("h7", n, 2001, ["a"]) for n in (1, 2, 3)])) == 2
    changed = [k for k, p in store._entries(2).items() if before.get(k) != p]
    assert all(sum(name == table for name, _ in changed) == 1 for table in ("imports", "questions", "members"))
    assert sum(name == "lists" for name, _ in changed) <= 2
    years = {(r.hash, r.number): r.year for r in store.read("questions", schema.QUESTION).collect()}
    assert len(years) == 81 and years["h7", 3] == 2001 and years["h8", 1] == 2000
    assert store.read("members", schema.MEMBER).count() == 81 and store.read("lists", schema.LIST).count() == 40
    old = store.read("questions", schema.QUESTION, at=1)
    assert old.count() == 80 and store.vacuum(keep=2, hours=0) == 0
    assert store.vacuum(keep=1, hours=0) > 0 and len(tables(store)["questions"]) == 81


def test_writers_of_other_buckets_merge(spark, store):
    rows = spark.createDataFrame([(f"h{k}",) for k in range(40)], "hash string")
    assert store.commit({"imports": rows}) == 1
    bucket = {r.hash: r.b for r in rows.select("hash", store.bucket(F.col("hash")).alias("b")).collect()}
    one = bucket["h0"]
    other = next(b for b in bucket.values() if b != one)
    anew = lambda b: store.read("imports", "hash string", [b], 1).where("hash <> 'h0'")
    assert store.commit({"imports": anew(one)}, 1, {"imports": [one]}) == 2
    assert store.commit({"imports": anew(other).limit(0)}, 1, {"imports": [other]}) == 3  # it read version 1, too
    left = {r.hash for r in store.read("imports", "hash string").collect()}
    assert left == {h for h, b in bucket.items() if h != "h0" and b != other}
    with pytest.raises(RuntimeError, match="same buckets since version 1"):
        store.commit({"imports": anew(one)}, 1, {"imports": [one]})
    with pytest.raises(Exception, match="outside the buckets"):
        store.commit({"imports": rows}, 3, {"imports": [one]})
    store.claim(3)
    with pytest.raises(RuntimeError, match="another writer follows version 3"):
        store.commit({"imports": anew(one).limit(0)}, 3, {"imports": [one]}, patience=1)
    assert store.version() == 3


def test_a_list_without_origin_is_found_by_its_id(spark, store):
    docs = spark.createDataFrame([("h1", "f.pdf", None, "T", "d", "t")], DOCS)
    p = payload(spark, [("h1", 1, 2000, ["a"])])
    bank.import_documents(store, docs, p)
    imports, lists = bank.delete_imports(store.read("imports", schema.IMPORT), store.read("lists", schema.LIST), docs.select("hash"))
    store.commit({"imports": imports, "lists": lists})
    bank.import_documents(store, docs.withColumn("topic", F.lit("new")), p)
    assert [(r.hash, r.topic) for r in store.read("lists", schema.LIST).collect()] == [(None, "new")]


def test_text_that_looks_like_a_group_reference(spark):
    row = spark.range(1).select(t.replace_figures(F.lit("![](figura:Q1) figura:Q11"), F.array(F.struct(F.lit("Q1").alias("name"), F.lit("https://a/$1\\b").alias("url")))).alias("x")).first()
    assert row.x == "![](https://a/$1\\b) figura:Q11"


def test_an_import_leaves_no_shuffle_files_and_reads_its_payload_once(spark, store):
    docs = spark.createDataFrame([("h1", "a.pdf", "lista", "T", "d", "t")], DOCS)
    rows = payload(spark, [("h1", n, 2000, ["a"]) for n in range(3)]).repartition(3)
    taken = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            taken.add(b.num_rows)
            yield b

    before = spark.conf.get(bank.FREE, None)
    bank.import_documents(store, docs, rows.mapInArrow(seen, rows.schema))
    assert taken.value == 3 and spark.conf.get(bank.FREE, None) == before
    assert store._names(f"{store.root}/_incoming") == []
    assert store.read("questions", schema.QUESTION).count() == 3


def test_a_commit_frees_what_it_dealt_out(spark, store):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files_there = lambda: set(re.findall(r"shuffle_\d+", blocks.getAllBlocks().mkString(" ")))
    before = files_there()
    store.commit({"imports": spark.range(1000).groupBy((F.col("id") % 7).cast("string").alias("hash")).count()})
    for _ in range(50):
        if files_there() <= before:
            break
        time.sleep(0.1)
    assert files_there() <= before
