"""Queries of page layout, rich text, list keeping and rules, each with its SQL.

Stand-ins for pages: a document is a customer or an order, a page an order or a line item;
boxes come from their numbers. Cases of rules are spelled out and dealt to documents by id.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import numeric, rich
from ..functions import text as t
from ..operators import assemble, bank, export, ordered, segment, spatial, validate, views
from .queries import _N, numbered_lines, query, table


def _n() -> Column:
    return F.col("number")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_lines(spark, sf_dir).withColumn("doc", F.col("l_orderkey"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of their customer."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))


# Page layout


@query(f"""
WITH {_N} SELECT l_orderkey AS doc, CAST(number % 2 AS INTEGER) AS page, CAST(number // 3 AS INTEGER) AS line, string_agg(l_suppkey::VARCHAR, '' ORDER BY number) AS text,
  min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice + 1) AS y1 FROM n GROUP BY ALL""")
def page_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _lines(spark, sf_dir).select("doc", (_n() % 2).alias("page"), F.lit(0).alias("block"), F.floor(_n() / 3).cast("int").alias("line"), _n().alias("ord"), F.col("l_suppkey").cast("string").alias("text"), F.col("l_quantity").alias("x0"), F.col("l_quantity").alias("x1"), F.col("l_extendedprice").alias("y0"), (F.col("l_extendedprice") + 1).alias("y1"))
    return segment.text_lines(spans).drop("block")


@query("""
WITH i AS (SELECT user_id AS doc, event_id % 3 AS page, event_id AS ord, value AS x0, value + event_id % 120 AS x1, CAST(event_id % 50 AS DOUBLE) AS y0, event_id % 50 + value AS y1 FROM events)
SELECT doc, page, ord FROM i WHERE ((x1 - x0 >= 30 AND y1 - y0 >= 30) OR (x1 - x0 >= 80 AND y1 - y0 >= 12)) AND y0 > 30""")
def page_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), (i % 3).alias("page"), i.alias("ord"), F.col("value").alias("x0"), (F.col("value") + i % 120).alias("x1"), (i % 50).cast("double").alias("y0"), (i % 50 + F.col("value")).alias("y1"))
    return segment.figures(e).select("doc", "page", "ord")


@query("""
WITH i AS (SELECT o_custkey AS doc, o_orderkey AS page, l_linenumber AS ord, CAST(l_quantity AS DOUBLE) * 10 AS x0, CAST(l_quantity AS DOUBLE) * 10 + l_partkey % 6 AS x1, 100 + l_suppkey % 7 * 100 AS h, l_suppkey % 3 AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT o_custkey AS doc, o_orderkey AS page, coalesce((SELECT arg_min((x0 + x1) / 2, ord) FROM i WHERE i.page = o_orderkey AND x1 - x0 < 3 AND h > 480), 300.0) AS middle FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o_orderkey GROUP BY l_linenumber HAVING count(*) > 1)""")
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, height = F.col("l_quantity").cast("double") * 10, 100.0 + F.col("l_suppkey") % 7 * 100
    rows = table(spark, sf_dir, "lineitem")
    once_each = rows.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").select(F.col("l_orderkey").alias("page")).distinct()
    pages = _orders(spark, sf_dir).join(once_each, "page", "left_anti")
    images = rows.join(pages.select("doc", F.col("page").alias("l_orderkey")), "l_orderkey").select("doc", F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ord"), q.alias("x0"), (q + F.col("l_partkey") % 6).alias("x1"), F.lit(10.0).alias("y0"), (height + 10).alias("y1"))
    return segment.column_split(pages, images).select("doc", "page", "middle")


@query("""
WITH l AS (SELECT l_orderkey AS page, 600 + l_partkey % 200 AS y0, l_suppkey % 4 AS kind FROM lineitem)
SELECT o_custkey AS doc, o_orderkey AS page, coalesce((SELECT min(y0) FROM l WHERE page = o_orderkey AND kind = 0 AND y0 > 640), (SELECT min(y0 - 8) FROM l WHERE page = o_orderkey AND kind = 1 AND y0 > 680), 770)::DOUBLE AS bottom FROM orders""")
def page_bottoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _orders(spark, sf_dir)
    y0 = (600 + F.col("l_partkey") % 200).cast("double")
    rows = table(spark, sf_dir, "lineitem").join(pages.select("doc", F.col("page").alias("l_orderkey")), "l_orderkey").select("doc", F.col("l_orderkey").alias("page"), y0.alias("y0"), (F.col("l_suppkey") % 4).alias("kind"))
    rules = rows.where("kind = 0 or kind = 2").select("doc", "page", F.lit(10.0).alias("x0"), F.when(F.col("kind") == 0, 590.0).otherwise(400.0).alias("x1"), "y0", (F.col("y0") + 2).alias("y1"))
    texts = rows.where("kind = 1 or kind = 3").select("doc", "page", "y0", F.when(F.col("kind") == 1, "Plataforma, 2026").otherwise("page foot").alias("text"))
    return segment.column_bottom(pages, texts, rules)


@query("""
SELECT source AS doc, doc_id AS page, CAST(doc_id % 9 * 10 + doc_id % 7 AS INTEGER) AS number FROM documents WHERE doc_id % 3 = 0 AND doc_id % 60 > 30""")
def question_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    text = F.when(i % 3 == 0, F.concat(F.lit(" Questão "), i % 9, F.lit(" "), i % 7, F.lit(" UF 2001"))).otherwise(F.concat(F.lit("see Questão "), i % 7))
    lines = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), i.alias("page"), text.alias("text"), F.lit(10.0).alias("x0"), (i % 60).cast("double").alias("y0"), F.lit(300.0).alias("x1"), (i % 60 + 12).cast("double").alias("y1"))
    return segment.bars(lines).select("doc", "page", "number")


@query(f"""
WITH {_N}, f AS (SELECT l_orderkey AS page, CASE WHEN l_suppkey % 7 = 0 THEN 320 ELSE 20 END AS x0, l_partkey % 4 <> 0 AS bar, l_partkey % 3 <> 2 AS box, l_partkey % 2 = 0 AS wide FROM n WHERE number = 1),
c AS (SELECT l_orderkey AS page, count(*) AS crossing FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey AS doc, page, CASE WHEN NOT bar THEN NULL WHEN x0 >= 300 THEN false WHEN box THEN wide ELSE crossing >= 3 END AS own FROM f JOIN c USING (page) JOIN orders ON o_orderkey = page)
SELECT doc, page, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page), false) AS one_column FROM o""")
def page_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = numbered_lines(spark, sf_dir).withColumn("page", F.col("l_orderkey")).join(_orders(spark, sf_dir), "page")
    first, on = n.where("number = 1"), ["doc", "page"]
    x0 = F.when(F.col("l_suppkey") % 7 == 0, 320.0).otherwise(20.0)
    bars = first.where("l_partkey % 4 <> 0").select(*on, "number", x0.alias("x0"), F.lit(100.0).alias("y0"), (x0 + 60).alias("x1"), F.lit(110.0).alias("y1"), F.lit("Questão 1").alias("text"))
    fill = F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))
    drawings = first.where("l_partkey % 3 <> 2").select(*on, (x0 - 1).alias("x0"), F.lit(98.0).alias("y0"), F.when(F.col("l_partkey") % 2 == 0, 580.0).otherwise(280.0).alias("x1"), F.lit(112.0).alias("y1"), fill.alias("fill"))
    lines = n.select(*on, F.lit("a long line of text").alias("text"), F.lit(100.0).alias("x0"), F.lit(200.0).alias("y0"), F.lit(400.0).alias("x1"), F.lit(210.0).alias("y1"))
    pages = first.select(*on, "width", "height")
    return segment.page_model(pages, lines, bars, drawings)


@query(f"""
WITH {_N}, b AS (SELECT o_custkey AS doc, l_orderkey AS page, number, number * 100.0 AS y FROM n JOIN orders ON o_orderkey = l_orderkey),
s AS (SELECT doc, page, 'new' AS kind, number, y - 2 AS y0, coalesce(lead(y) OVER (PARTITION BY page ORDER BY y), 770) - 2 AS y1 FROM b
  UNION ALL SELECT doc, page, 'continued', NULL, 30, min(y) - 2 FROM b WHERE page % 2 = 0 GROUP BY doc, page)
SELECT doc, page, kind, number, CAST(y0 AS DOUBLE) AS y0, CAST(y1 AS DOUBLE) AS y1, last_value(number IGNORE NULLS) OVER w AS question, CAST(row_number() OVER w AS INTEGER) AS ord FROM s WINDOW w AS (PARTITION BY doc ORDER BY page, y0)""")
def question_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments from each bar to the next, one before the first where something stands, and
    the question that each belongs to."""
    n = numbered_lines(spark, sf_dir).withColumn("page", F.col("l_orderkey")).join(_orders(spark, sf_dir), "page")
    pages = n.where("number = 1").select("doc", "page", "width", "height")
    bars = n.select("doc", "page", "number", F.lit(20.0).alias("x0"), (_n() * 100.0).alias("y0"), F.lit(80.0).alias("x1"), (_n() * 100.0 + 10).alias("y1"), F.lit("Questão").alias("text"))
    lines = pages.where("page % 2 = 0").select("doc", "page", F.lit("goes on here").alias("text"), F.lit(20.0).alias("x0"), F.lit(50.0).alias("y0"), F.lit(90.0).alias("x1"), F.lit(60.0).alias("y1"))
    images = spark.createDataFrame([], "doc long, page long, ord int, x0 double, y0 double, x1 double, y1 double")
    model = pages.select("doc", "page", F.lit(True).alias("one_column"))
    found = segment.segments(pages, images, lines, bars, model, pages.select("doc", "page", F.lit(770.0).alias("bottom")))
    return segment.assign_questions(found).select("doc", "page", "kind", "number", "y0", "y1", "question", "ord")


@query(f"""
WITH {_N}, p AS (SELECT l_orderkey, number, CAST(l_quantity AS DOUBLE) AS y FROM n WHERE number % 2 = 1)
SELECT s.l_orderkey AS doc, s.number, coalesce((SELECT arg_max(p.number, struct_pack(y := p.y, n := -p.number)) FROM p WHERE p.l_orderkey = s.l_orderkey AND s.l_quantity + 5 >= p.y - 2), 1) AS part FROM n s WHERE number % 2 = 0""")
def stray_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _lines(spark, sf_dir).select("doc", "number", F.col("l_quantity").cast("double").alias("y0"), (F.col("l_quantity") + 10).cast("double").alias("y1"))
    parts = n.where("number % 2 = 1").select("doc", _n().alias("part"), "y0", _n().alias("ord"))
    return spatial.owner(n.where("number % 2 = 0"), parts, ["doc"], ["doc", "number"])


@query("""
WITH s AS (SELECT o_custkey AS doc, max(o_orderkey) AS last FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT doc, min(o_orderkey) AS page FROM orders JOIN s ON doc = o_custkey WHERE o_orderkey % 3 <> 0 AND o_orderkey > last GROUP BY doc""")
def answer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _orders(spark, sf_dir)
    return segment.answer_page(pages, pages.where("page % 3 = 0").select("doc", "page"))


@query(f"""
WITH {_N}, f AS (SELECT l_orderkey AS doc, number, l_partkey % 300 AS x0, l_partkey % 300 + 20 + l_suppkey % 400 AS x1 FROM n)
SELECT doc, number, x1 - x0 >= 425 OR abs((x0 + x1) / 2.0 - 300) < 25 OR abs((x0 + x1) / 2.0 - 310) < 25 AS centred FROM f""")
def figures_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0 = (F.col("l_partkey") % 300).cast("double")
    f = _lines(spark, sf_dir).select("doc", "number", x0.alias("x0"), (x0 + 20 + F.col("l_suppkey") % 400).alias("x1"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("y1"))
    extents = f.select("doc", "number", F.lit(50.0).alias("left"), F.lit(550.0).alias("right"), F.lit(310.0).alias("region_mid"))
    return segment.centred_figures(f, extents, ["doc", "number"]).select("doc", "number", "centred")


@query(f"""
WITH {_N} SELECT l_orderkey AS doc, number, 'Q' || printf('%02d', number % 3) || '_fig' || row_number() OVER (PARTITION BY l_orderkey, number % 3 ORDER BY l_quantity, number) AS name,
  coalesce(sum(l_quantity + 6) OVER (PARTITION BY l_orderkey, number % 3 ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS "offset" FROM n""")
def figure_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a question's figures, and where its parts begin when they are stacked."""
    f = _lines(spark, sf_dir).select("doc", "number", (_n() % 3).alias("question"), F.col("l_quantity").cast("double").alias("part"), _n().alias("band"), F.lit(0).alias("x0"), F.col("l_quantity").cast("double").alias("height"))
    return segment.stacked_offsets(segment.number_figures(f), ["doc", "question"], ["number"]).select("doc", "number", "name", "offset")


@query("""
SELECT c_custkey AS doc, s.stage, s.rank, CAST(c_custkey % 90 + 3 * s.rank AS INTEGER) AS start FROM customer, (VALUES ('Fixação', 0), ('Treinamento', 1), ('Aprofundamento', 2), ('Desafios', 3)) s(stage, rank)
WHERE c_custkey % 4 <> s.rank AND c_custkey % 5 <> 0""")
def contents_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages and their pages as the contents page names them; one stage has no number near."""
    d = F.col("doc")
    lines = [F.struct(F.when(d % 5 != 0, "Sumário").otherwise("Index").alias("text"), F.lit(0.0).alias("base"), F.lit(0).alias("ord"))]
    for k, s in enumerate(segment.STAGES):
        y = 100.0 + 20 * k
        lines += [F.struct(F.lit(f" {s} ").alias("text"), F.lit(y).alias("base"), F.lit(2 * k + 1).alias("ord")), F.struct((d % 90 + 3 * k).cast("string").alias("text"), (F.lit(y) + F.when(d % 4 == k, 9.0).otherwise(5.0)).alias("base"), F.lit(2 * k + 2).alias("ord"))]
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.lit(2).alias("page")).select("doc", "page", F.inline(F.array(*lines)))
    return segment.stage_pages(rows)


@query("""
SELECT c_custkey AS doc, CASE WHEN c_custkey % 4 = 0 THEN true ELSE false END AS one_column, c_custkey % 6 = 0 AS beside FROM customer WHERE c_custkey % 4 < 2""")
def bar_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the text of bars says about columns: 0 at the page's right end, 1 in a column, 2 no bank, 3 in between."""
    d = F.col("doc")
    end = F.when(d % 4 == 0, 420.0).when(d % 4 == 1, 200.0).otherwise(310.0)
    spans = [F.struct(F.lit("Questão 7").alias("text"), F.lit(20.0).alias("x0"), F.lit(80.0).alias("x1")), F.struct(F.when(d % 4 == 2, "no bank").otherwise("UF").alias("text"), end.alias("x0"), (end + 20).alias("x1")), F.struct(F.lit("2001").alias("text"), (end + 25).alias("x0"), (end + 60).alias("x1"))]
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.lit(1).alias("page"), F.lit(600.0).alias("width"))
    bars = pages.select("doc", "page", F.lit(7).alias("number"), F.lit(20.0).alias("x0"), F.lit(100.0).alias("y0"), F.lit(110.0).alias("y1"))
    rows = pages.select("doc", "page", F.inline(F.array(*spans))).withColumn("y0", F.lit(99.0)).withColumn("y1", F.lit(111.0))
    second = bars.where("doc % 3 = 0").withColumn("x0", F.lit(320.0)).withColumn("y1", F.when(d % 6 == 0, 112.0).otherwise(120.0))
    beside = segment.side_by_side(bars.unionByName(second), pages).withColumn("beside", F.lit(True))
    return segment.bar_text_votes(bars, rows, pages).join(beside, ["doc", "page"], "left").select("doc", "one_column", F.coalesce("beside", F.lit(False)).alias("beside"))


@query("""
SELECT c_custkey AS doc, (c_custkey % 2 = 0) <> (CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 > 0 AND c_custkey % 5 < c_custkey % 3 ELSE c_custkey % 5 > 0 AND c_custkey % 3 < c_custkey % 5 END) AS one_column FROM customer""")
def corrected_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.lit(1).alias("page"))
    outside = lambda k: pages.select("doc", "page", F.explode(F.slice(F.array(*[F.lit(i) for i in range(k)]), F.lit(1), (F.col("doc") % k).cast("int"))))
    model = pages.withColumn("one_column", F.col("doc") % 2 == 0)
    return segment.better_model(model, outside(3), outside(5)).select("doc", "one_column")


# Rich text and readings


@query(rf"""
SELECT doc_id, concat('Item <strong>', doc_id, '</strong> &amp; $a<', doc_id, '$ <em>i</em>', chr(10), chr(10), '{rich.TABLE}<thead><tr><th style="text-align: left;">a &lt; b</th><th style="text-align: right;">c \| d</th></tr></thead><tbody><tr><td style="text-align: left;">', doc_id,
  '</td><td style="text-align: right;">$x>', doc_id % 9, '$</td></tr></tbody></table>', chr(10), chr(10), '{rich.PARAGRAPH}<strong>mid</strong><br>', lang, '</p>', chr(10), chr(10), CASE WHEN doc_id % 2 = 0 THEN '{rich.PARAGRAPH}<img src="figura:Q1" alt="a &amp; b"></p>' ELSE '![a & b](figura:Q1)' END,
  chr(10), chr(10), '{t.REFERENCE_OPEN}Fonte: livro ', doc_id, '{t.REFERENCE_CLOSE}') AS html FROM documents""")
def rich_text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    # Inline markup is converted in cells and centred blocks only, so the first paragraph stands in one of its own.
    text = F.concat(F.lit("| a < b | c \\| d |\n|:--|--:|\n| "), i, F.lit(" | $x>"), (F.col("doc_id") % 9).cast("string"), F.lit("$ |\n::: centro\n**mid**\n"), F.col("lang"), F.lit("\n:::\n\n![a & b](figura:Q1)\n\n**Fonte: livro "), i, F.lit("**"))
    head = rich.inline_html(F.concat(F.lit("Item **"), i, F.lit("** & $a<"), i, F.lit("$ *i*")))
    known = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("Q1"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.lit("\n\n"), rich.normalise(text, known)).alias("html"))


@query(f"""
WITH {_N} SELECT l_orderkey, string_agg(printf('%02d', number) || '=' || chr((65 + l_partkey % 5)::INT), ' ' ORDER BY printf('%02d', number)) AS answers FROM n GROUP BY l_orderkey""")
def answers_in_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = numbered_lines(spark, sf_dir)
    row = F.concat(_n().cast("string"), F.lit("  "), F.chr(65 + F.col("l_partkey") % 5), F.when(_n() % 3 == 0, "\nno 4 E here\n").otherwise("  "))
    pages = n.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", row.alias("r")))), lambda x: x["r"]), "").alias("page"))
    pairs = F.array_sort(F.map_entries(t.inline_answers(F.col("page"))))
    return pages.select("l_orderkey", F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"])), " ").alias("answers"))


@query(r"""
SELECT doc_id, concat('\frac{a}{', doc_id, '}+\ x\mathrm{ab}=\alpha b') AS tight, concat('\fraca', doc_id, '+x\mathrmab=\alphab') AS key FROM documents""")
def formula_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    read = F.concat(F.lit(r"\frac  {a } { "), i, F.lit(r" } +\   x \mathrm {a b}  =  \alpha   b"))
    return table(spark, sf_dir, "documents").select("doc_id", t.tight_formula(read).alias("tight")).select("doc_id", "tight", t.reading_key(F.col("tight")).alias("key"))


@query("""
WITH b AS (SELECT user_id, event_type, max(value) AS score FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type DESC) AS k FROM b)
SELECT a.user_id, a.event_type, a.score, a.score - c.score AS margin FROM r a LEFT JOIN r c ON a.user_id = c.user_id AND c.k = 2 WHERE a.k = 1""")
def best_and_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("value").alias("score"))
    return ordered.top_margin(rows, ["user_id"], "event_type", "score")


@query("SELECT user_id, arg_min(event_id, event_id) FILTER (WHERE value > 90) AS chosen FROM events GROUP BY user_id")
def first_valid_try(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.first_valid(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("value") > 90, "event_id").select("user_id", F.col("event_id").alias("chosen"))


@query(f"""
WITH {_N}, a AS (SELECT l_orderkey, list(CAST(l_quantity AS DOUBLE) ORDER BY l_quantity) AS a, list(CAST(l_quantity AS DOUBLE) ORDER BY l_quantity DESC) AS d FROM n GROUP BY 1)
SELECT l_orderkey, CASE WHEN len(a) >= 4 THEN round(list_avg(list_filter(a, lambda x: x <= 2.5 * a[len(a) // 2 + 1])), 6) END AS mean,
  CASE WHEN len(a) >= 2 AND d[2] >= 2 AND d[2] >= 1.15 * coalesce(d[3], 0) THEN d[1] + d[2] END AS cuts FROM a""")
def trimmed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean stroke of a word, and the two gaps that part three words."""
    rows = numbered_lines(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("double")).alias("a"))
    return rows.select("l_orderkey", F.round(numeric.trimmed_mean(F.col("a")), 6).alias("mean"), numeric.total(ordered.word_cuts(F.col("a"), F.lit(3))).alias("cuts"))


# Lists and the bank


@query(f"""
WITH {_N}, q AS (SELECT l_orderkey, number, p_size % 5 + 1 AS difficulty, ['Fixação', 'Treinamento', 'Aprofundamento', 'Desafios'][p_size % 5 + 1] AS stage, p_size % 3 AS figures FROM n JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, stage, min(number) AS first, max(number) AS last, round(avg(difficulty), 6) AS mean, (SELECT sum(figures) FROM q x WHERE x.l_orderkey = q.l_orderkey)::BIGINT AS figures, count(*) FILTER (WHERE difficulty >= 4) AS hard FROM q WHERE stage IS NOT NULL GROUP BY ALL""")
def stage_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    q = numbered_lines(spark, sf_dir).join(part, "l_partkey")
    stage = F.get(F.array(*[F.lit(s) for s in segment.STAGES]), (F.col("p_size") % 5).cast("int"))
    q = q.select("l_orderkey", "number", (F.col("p_size") % 5 + 1).alias("difficulty"), stage.alias("stage"), F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), (F.col("p_size") % 3).cast("int")).alias("figures"))
    hard = views.hard_questions(q).groupBy("l_orderkey", "stage").agg(F.count(F.lit(1)).alias("hard"))
    means = validate.stage_means(q, "l_orderkey").select("l_orderkey", "stage", F.round("mean", 6).alias("mean"))
    out = views.stage_summary(q, "l_orderkey").join(means, ["l_orderkey", "stage"]).join(views.figure_count(q, "l_orderkey"), "l_orderkey")
    return out.join(hard, ["l_orderkey", "stage"], "left").na.fill(0, ["hard"])


@query("SELECT conv_id, role AS status, count(*) AS n FROM conversations GROUP BY ALL UNION ALL SELECT doc_id, lang, 1 FROM documents")
def outcomes_of_banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many results ended in each way, over the union of two banks."""
    a = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("status"))
    per = views.outcomes(a, ["conv_id"])
    return views.union_banks([per, table(spark, sf_dir, "documents").select(F.col("lang").alias("status"), F.lit(1).cast("long").alias("n"), F.col("doc_id").alias("conv_id"))])


@query("""
SELECT doc_id AS number, printf('%s/%02d', source, doc_id) AS id, (doc_id % 4 = 0)::INT + (doc_id % 3 = 0)::INT AS errors, (doc_id % 5 = 0)::INT AS warnings FROM documents WHERE doc_id % 4 = 0 OR doc_id % 3 = 0""")
def review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light rows of questions with errors."""
    i, text = F.col("number"), F.lit("x")
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("number"), F.col("text").alias("statement"))
    q = d.select("doc", "number", "statement", *[text.alias(c) for c in ("title", "institution", "discipline", "topic", "stage")], F.lit(1).alias("year"), F.lit(1).alias("difficulty"), F.array(text).alias("subjects"))
    issue = lambda every, severity: d.where(i % every == 0).select("doc", "number", F.lit(severity).alias("severity"))
    rows = views.question_rows(q, issue(4, "E").unionByName(issue(3, "E")).unionByName(issue(5, "W")))
    return views.review_rows(rows, "errors").select("number", "id", F.col("errors").cast("int").alias("errors"), F.col("warnings").cast("int").alias("warnings"))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    return rows.select(c.cast("string").alias("list_id"), F.col("c_name").alias("name"), F.lit("d").alias("description"), F.col("c_mktsegment").alias("discipline"), F.lit("t").alias("topic"), F.array(F.lit("a")).alias("tags"), F.lit("rascunho").alias("status"), (c % 50).cast("string").alias("hash"), (c * 7 % 1000).alias("created"), (c * 7 % 1000).alias("updated"))


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS list_id, CASE WHEN c_custkey % 3 = 0 THEN 'New' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS discipline, CASE WHEN c_custkey % 3 = 1 THEN 'x,y' ELSE 'a' END AS tags,
  CASE WHEN c_custkey % 2 = 0 THEN 'publicada' ELSE 'rascunho' END AS status FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'new', 'Nova lista', NULL, '', 'rascunho'""")
def lists_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists after one is made, some are changed by what is given, published and deleted."""
    lists = _lists(spark, sf_dir)
    i = F.col("list_id").cast("long")
    made = bank.create_lists(spark.createDataFrame([("new", None)], "list_id string, name string"), F.lit(0).cast("long"))
    given = F.when(i % 3 == 0, F.create_map(F.lit("name"), F.lit("New"), F.lit("discipline"), F.lit(None).cast("string"))).when(i % 3 == 1, F.create_map(F.lit("tags"), F.lit('["x","y"]')))
    out = bank.named(bank.patch(lists, lists.where(i % 3 != 2).select("list_id", given.alias("given"))))
    out = bank.publish(out, lists.where(i % 2 == 0).select("list_id"))
    out, _ = bank.delete_lists(out, lists.select("list_id"), lists.where(i % 7 == 0).select("list_id"))
    return out.unionByName(made).select("list_id", "name", "discipline", F.array_join("tags", ",").alias("tags"), "status")


@query("""
SELECT hash, arg_min(list_id, struct_pack(c := created, i := list_id)) AS list_id FROM (SELECT CAST(c_custkey % 50 AS VARCHAR) AS hash, CAST(c_custkey AS VARCHAR) AS list_id, c_custkey * 7 % 1000 AS created FROM customer) GROUP BY hash""")
def first_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.first_list_of(_lists(spark, sf_dir))


@query(f"""
WITH {_N}, a AS (SELECT CAST(o_custkey AS VARCHAR) AS list_id, CAST(l_orderkey AS VARCHAR) AS hash, number, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, number) AS p FROM n JOIN orders ON o_orderkey = l_orderkey WHERE number <= 2),
m AS (SELECT list_id, hash, number, CAST(min(p) AS INTEGER) AS position FROM a WHERE CAST(list_id AS BIGINT) % 2 = 0 GROUP BY ALL
  UNION ALL SELECT CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), number, 1 FROM n JOIN orders ON o_orderkey = l_orderkey WHERE number = 1 AND o_custkey % 2 = 1)
SELECT m.list_id, hash, number, position, CASE WHEN CAST(m.list_id AS BIGINT) % 2 = 0 THEN 'saved' ELSE c_name END AS name FROM m JOIN customer ON CAST(c_custkey AS VARCHAR) = m.list_id""")
def lists_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lists saved: their rows put over the old ones, their members replaced."""
    n = numbered_lines(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey")), "l_orderkey")
    questions = n.select(F.col("l_orderkey").cast("string").alias("hash"), "number")
    members = n.where("number = 1").select(F.col("o_custkey").cast("string").alias("list_id"), F.col("l_orderkey").cast("string").alias("hash"), "number", F.lit(1).alias("position"))
    asked = n.where("number <= 2 and o_custkey % 2 = 0").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "number"))).alias("q"))
    text = lambda c, v: F.lit(v).alias(c)
    wanted = asked.select(F.col("o_custkey").cast("string").alias("list_id"), text("name", "saved"), text("description", None), text("discipline", ""), text("topic", "t"), F.array(F.lit("z")).alias("tags"), text("status", None), F.transform("q", lambda x: F.struct(x["l_orderkey"].cast("string").alias("hash"), x["number"].alias("number"))).alias("questions"))
    wanted = wanted.withColumn("description", F.col("description").cast("string")).withColumn("status", F.col("status").cast("string"))
    lists, kept = bank.save_lists(_lists(spark, sf_dir), members, wanted, questions, F.lit(5).cast("long"))
    return kept.join(lists.select("list_id", "name"), "list_id").select("list_id", "hash", "number", "position", "name")


@query(f"""
WITH {_N} SELECT CAST(l_orderkey AS VARCHAR) AS hash, number, p_type AS statement, year(l_shipdate)::INTEGER AS year, number % 2 = 0 AND l_orderkey % 3 = 0 AS published, 'Lista completa de T' || l_orderkey AS description, number AS position,
  (SELECT count(*) FROM n x WHERE x.l_orderkey = n.l_orderkey)::INTEGER AS total FROM n JOIN part ON l_partkey = p_partkey""")
def bank_imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank after the same documents came in twice; some questions were published between."""
    store = bank.BankStore(spark, f"{shared(spark)}/bank-{spark.range(1).select(F.uuid()).first()[0]}")
    n = numbered_lines(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    kinds = {f.split()[0]: f.split(" ", 1)[1] for f in _fields(schema.QUESTION)}
    have = {"hash": F.col("l_orderkey").cast("string"), "number": _n(), "statement": F.col("p_type"), "year": F.year("l_shipdate"), "subjects": F.array("p_type")}
    payload = n.select(*[have.get(c, F.lit(None).cast(k)).alias(c) for c, k in kinds.items() if c != "published"])
    documents = payload.select("hash").distinct().select("hash", F.lit("f.pdf").alias("file"), F.lit(None).cast("string").alias("kind"), F.concat(F.lit("T"), "hash").alias("title"), F.lit("d").alias("discipline"), F.lit("t").alias("topic"))
    first = bank.import_documents(store, documents, payload.withColumn("year", F.lit(1)))
    stored = store.read("questions", schema.QUESTION)
    store.commit({"questions": stored.withColumn("published", (_n() % 2 == 0) & (F.col("hash").cast("long") % 3 == 0))}, first)
    bank.import_documents(store, documents, payload)
    questions, lists, members, imports = [store.read(k, s) for k, s in (("questions", schema.QUESTION), ("lists", schema.LIST), ("members", schema.MEMBER), ("imports", schema.IMPORT))]
    return questions.join(members, ["hash", "number"]).join(lists.select("list_id", F.col("description")), "list_id").join(imports.select("hash", "total"), "hash").select("hash", "number", "statement", "year", "published", "description", "position", "total")


@query(f"""
WITH {_N}, h AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS hash, l_orderkey % 2 = 0 AS saved FROM n)
SELECT hash, CASE WHEN saved THEN 'mine' ELSE 'Lista de T' || hash END AS name, CASE WHEN saved THEN 2 ELSE 1 END AS created, 3 AS updated, 1 AS import_created, 3 AS import_updated, saved AS moved FROM h""")
def bank_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come in on day 1; on day 2 half of their lists are deleted and saved anew under other ids, with the
    same origin; on day 3 the documents come in again. Times are days; moved: the list is the one saved."""
    store = bank.BankStore(spark, f"{shared(spark)}/bank-{spark.range(1).select(F.uuid()).first()[0]}")
    n = numbered_lines(spark, sf_dir)
    day = lambda k: F.lit(f"2026-01-0{k} 00:00:00").cast("timestamp")
    kinds = {f.split()[0]: f.split(" ", 1)[1] for f in _fields(schema.QUESTION)}
    have = {"hash": F.col("l_orderkey").cast("string"), "number": _n()}
    payload = n.select(*[have.get(c, F.lit(None).cast(k)).alias(c) for c, k in kinds.items() if c != "published"])
    documents = payload.select("hash").distinct().select("hash", F.lit("f.pdf").alias("file"), F.lit(None).cast("string").alias("kind"), F.concat(F.lit("T"), "hash").alias("title"), F.lit("d").alias("discipline"), F.lit("t").alias("topic"))
    first = bank.import_documents(store, documents, payload, day(1))
    lists, members, questions = store.read("lists", schema.LIST), store.read("members", schema.MEMBER), store.read("questions", schema.QUESTION)
    ours = lists.where(F.col("hash").cast("long") % 2 == 0)
    asked = questions.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("hash", "number"))).alias("questions"))
    saved = ours.join(asked, "hash").select(F.concat(F.lit("own-"), "list_id").alias("list_id"), F.lit("mine").alias("name"), "description", "discipline", "topic", "tags", "status", "hash", "questions")
    left, rest = bank.delete_lists(lists, members, ours.select("list_id"))
    left, rest = bank.save_lists(left, rest, saved, questions, day(2))
    store.commit({"lists": left, "members": rest}, first)
    bank.import_documents(store, documents, payload, day(3))
    lists, imports = store.read("lists", schema.LIST), store.read("imports", schema.IMPORT)
    held = store.read("members", schema.MEMBER).select("list_id").distinct()  # no list of a document is left without its questions
    own = bank.first_list_of(lists).join(lists.drop("hash"), "list_id").join(held, "list_id", "left_semi")
    when = imports.select("hash", F.day("created").alias("import_created"), F.day("updated").alias("import_updated"))
    return own.join(when, "hash").select("hash", "name", F.day("created").alias("created"), F.day("updated").alias("updated"), "import_created", "import_updated", F.col("list_id").startswith("own-").alias("moved"))


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; local mode may make one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or f"file://{tempfile.mkdtemp(prefix='spark-')}").rstrip("/")


def _fields(ddl: str) -> list[str]:
    """The top-level fields of a DDL schema."""
    from pyspark.sql.types import StructType

    return [f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl)]


@query("""
WITH p AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS p FROM orders WHERE o_custkey % 3 <> 0 GROUP BY ALL)
SELECT CAST(o_custkey AS VARCHAR) AS list_id, string_agg(o_orderpriority, ' > ' ORDER BY p) AS origins FROM p GROUP BY o_custkey""")
def push_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to send before each list; lists with questions that have errors aren't asked for."""
    orders = table(spark, sf_dir, "orders")
    members = orders.select(F.col("o_custkey").cast("string").alias("list_id"), F.col("o_orderpriority").alias("hash"), F.col("o_orderkey").alias("number"), F.col("o_orderkey").alias("position"))
    issues = orders.where("o_custkey % 3 = 0").select(F.col("o_orderpriority").alias("hash"), F.col("o_orderkey").alias("number"), F.lit("E").alias("severity"))
    clean = members.where(F.col("list_id").cast("long") % 3 != 0)
    return bank.push_order(clean, issues).select("list_id", F.array_join("hashes", " > ").alias("origins"))


@query(f"""
WITH {_N} SELECT CAST(l_orderkey AS VARCHAR) AS doc, 'Lista de T' || l_orderkey AS name, string_agg(number || ':' || p_type || ':' || 'https://store/' || substr('h' || l_orderkey, 1, 16) || '/Q' || number || '.png', ';' ORDER BY number) AS questions, CASE l_orderkey % 2 WHEN 0 THEN 'simulado' ELSE 'lista' END AS kind FROM n JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""")
def import_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents with uploaded figures, as an import takes them."""
    n = numbered_lines(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    figure = F.struct(F.concat(F.lit("Q"), _n().cast("string")).alias("name"), F.lit("f").alias("file"), F.lit(False).alias("centred"), F.lit(False).alias("table"))
    q = n.select(F.col("l_orderkey").cast("string").alias("doc"), "number", F.col("p_type").alias("statement"), F.array("p_type").alias("subjects"), F.array(figure).alias("figures"), F.lit("i").alias("image"), F.lit("s").alias("source_text"), F.array(F.lit("o")).alias("outside"))
    file = F.when(F.col("doc").cast("long") % 2 == 0, "1º Simulado.pdf").otherwise("x.pdf")
    documents = q.select("doc").distinct().select("doc", F.concat(F.lit("h"), "doc").alias("hash"), F.concat(F.lit("T"), "doc").alias("title"), assemble.document_kind(file, F.lit("")).alias("kind"), F.lit(None).cast("string").alias("answers"))
    nested = export.payload(export.upload_figures(assemble.list_documents(q, documents), F.lit("https://store/")))
    shown = F.transform("questions", lambda x: F.concat_ws(":", x["number"].cast("string"), x["statement"], F.get(x["figures"], F.lit(0))["url"]))
    return nested.select("doc", "name", F.array_join(shown, ";").alias("questions"), "kind")


# Rules

_FIG = "array<struct<name:string,file:string,centred:boolean,table:boolean>>"
_BODY = "Questão 7 UF 2001\nO valor medido foi anotado pelos alunos"
#: (source text, statement, figures as name:table, change of another column, the rules that it breaks). Bound to question 7.
_CASES: list[tuple[str | None, str, str, str, tuple[str, ...]]] = [
    (None, "all is well", "", "", ()),
    (_BODY, "O valor medido foi anotado pelos alunos", "", "", ()),
    (_BODY, "O valor", "", "", ("words_missing",)),
    (_BODY + " em 1250 metros", "O valor medido foi anotado pelos alunos em metros", "", "", ("numbers_missing",)),
    (_BODY.replace("medido", "**medido**"), "O valor medido foi anotado pelos alunos", "", "", ("bold_lost",)),
    (_BODY.replace("medido", "**medido**"), "O valor <strong>medido</strong> foi anotado pelos alunos", "", "", ()),
    (_BODY + "\n[centralizado] Tabela de valores", "O valor medido foi anotado pelos alunos\nTabela de valores", "", "", ("centring_lost",)),
    (_BODY + "\n[centralizado] Tabela de valores", 'O valor medido foi anotado pelos alunos\n<p style="text-align: center;">Tabela de valores</p>', "", "", ()),
    (_BODY + "\n[centralizado] Tabela de valores", 'O valor medido foi anotado pelos alunos\nTabela de valores\n<p style="text-align: center;">Tabela de valores</p>', "", "", ("lines_repeated",)),
    ("O valor medido", "O valor medido", "", "", ("cut_mixed",)),
    (_BODY + "\nQuestão 8 UF 2002", _BODY.split("\n")[1] + " Questão 8 UF 2002", "", "", ("cut_mixed",)),
    ("Questão 7\ntexto longo\nUF 2002", "texto longo UF 2002", "", "", ("cut_mixed",)),
    ("Questão 7 UF 2001\nA um\nC dois\nB tres", "um dois tres", "", "", ("cut_mixed",)),
    (None, "a passagem é ilegível", "", "", ("not_read",)),
    (None, "![x](figura:Q07_fig1)", "Q07_fig1:0", "", ()),
    (None, "![x](figura:Q07_fig2)", "Q07_fig1:0", "", ("figure_unknown", "figure_unused")),
    (None, "![x](figura:Q07_fig1)", "Q07_fig1:1", "", ("table_as_figure",)),
    (None, "no table", "Q07_fig1:1", "", ("table_not_transcribed",)),
    (None, "| a |\n| b |", "Q07_fig1:1", "", ()),
    (None, "uses \\ce{H2O} outside and $\\ce{H2O}$ inside", "", "", ("command_unsupported",)),
    (None, "⟦FÓRMULA 3⟧ and \\left( x", "", "", ("formula_not_read", "latex_incoherent")),
    (None, "$\\frac{ }{ }$", "", "", ("latex_incoherent",)),
    (None, "stage", "", "stage", ("stage_unknown",)),
    (None, "year", "", "year", ("year_range",)),
    (None, "difficulty", "", "difficulty", ("difficulty_range",)),
    (None, "outside", "", "outside", ("content_outside",)),
    (None, "list", "", "list", ("topic_not_of_list",)),
    (None, "brace $\\frac{1}{2$ ² here", "", "", ("braces_unbalanced", "symbol_outside_math")),
]
_BROKEN = ", ".join(f"({k}, '{r}')" for k, (*_, rules) in enumerate(_CASES) for r in rules)


@query(f"SELECT doc_id, rule FROM documents JOIN (VALUES {_BROKEN}) v(k, rule) ON doc_id % {len(_CASES)} = k")
def rule_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case of _CASES, dealt to documents by id, breaks exactly the rules it names."""
    figure = lambda f: [{"name": x.split(":")[0], "file": "f", "centred": False, "table": x.endswith(":1")} for x in f.split(",") if x]
    cases = spark.createDataFrame([(k, s, x, figure(f), c) for k, (s, x, f, c, _) in enumerate(_CASES)], f"k int, source_text string, statement string, figures {_FIG}, change string")
    changed = lambda name, new, old: F.when(F.col("change") == name, new).otherwise(old)
    options = F.array(*[F.struct(F.lit(x).alias("letter"), F.lit("opt").alias("text")) for x in "AB"])
    q = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % len(_CASES)).cast("int").alias("k")).join(F.broadcast(cases), "k")  # a few dozen cases
    q = q.select(
        F.col("doc_id").cast("string").alias("doc"), F.lit(7).alias("number"), F.lit("d").alias("discipline"), changed("list", F.lit("other"), F.lit("t")).alias("topic"), F.array(changed("list", F.lit("other"), F.lit("t"))).alias("subjects"), changed("stage", F.lit("none"), F.lit("Fixação")).alias("stage"),
        changed("difficulty", F.lit(6), F.lit(1)).alias("difficulty"), "statement", options.alias("options"), F.lit("A").alias("answer"), F.lit(False).alias("review"), F.lit(None).cast("string").alias("notes"), changed("year", F.lit(1800), F.lit(2000)).alias("year"), "figures", "source_text", F.when(F.col("change") == "outside", F.array(F.lit("stray"))).alias("outside"),
    )
    documents = q.select("doc", F.lit("lista").alias("kind"), F.lit("d").alias("discipline"), F.lit("t").alias("topic"))
    topics = spark.createDataFrame([("d", "t", []), ("d", "other", [])], "discipline string, topic string, subjects array<string>")
    found = validate.validate(q, documents, topics).where("not (rule = 'difficulty_outside_stage')")
    return found.select(F.col("doc").cast("long").alias("doc_id"), "rule").distinct()


@query("""
SELECT source AS doc, count(*) FILTER (WHERE doc_id % 4 = 0) AS errors, count(*) FILTER (WHERE doc_id % 3 = 0) AS warnings, count(*) FILTER (WHERE doc_id % 4 = 0) > 0 AS forced, count(*) FILTER (WHERE doc_id % 4 = 0 OR doc_id % 3 = 0) > 0 AS blocked FROM documents WHERE doc_id % 4 = 0 OR doc_id % 3 = 0 GROUP BY 1""")
def issue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of issues, and what they block with and without force."""
    i = F.col("doc_id")
    issue = lambda every, severity: table(spark, sf_dir, "documents").where(i % every == 0).select(F.col("source").alias("doc"), F.lit(severity).alias("severity"))
    issues = issue(4, "E").unionByName(issue(3, "W"))
    out = validate.totals(issues, ["doc"]).join(validate.may_send(issues, force=True).withColumnRenamed("blocked", "forced"), "doc")
    return out.join(validate.may_send(issues), "doc")


@query(f"""
WITH {_N} SELECT CAST(l_orderkey AS VARCHAR) AS doc, coalesce(string_agg(printf('%02d', number), ',' ORDER BY number) FILTER (WHERE number > 3), '') AS without_answer, ['Muito Fácil', 'Fácil', 'Média', 'Difícil', 'Muito Difícil'][max(number) % 5 + 1] AS label FROM n GROUP BY l_orderkey""")
def answers_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = numbered_lines(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("doc"), "number")
    answers = F.map_from_arrays(F.array(*[F.lit(f"{k:02d}") for k in (1, 2, 3)]), F.array(F.lit("A"), F.lit("B"), F.lit("C")))
    labels = q.groupBy("doc").agg(assemble.difficulty_label((F.max("number") % 5 + 1).cast("int")).alias("label"))
    out = validate.partial_answers(q, q.select("doc").distinct().withColumn("answers", answers)).join(labels, "doc")
    return out.select("doc", F.array_join("without_answer", ",").alias("without_answer"), "label")
