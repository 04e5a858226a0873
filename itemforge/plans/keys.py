"""Queries of answer keys, letters of figures and marks in texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import answers
from .queries import _N, numbered_lines, query, table

# An order is a list, its line items are questions on page 1. Their answers stand on page 2 as pairs in one piece, on
# page 3 in two pieces or two lines, some on page 1; page 3 has other letters for some of page 2; some have none.
_KEYS = f"""
WITH {_N}, q AS (SELECT l_orderkey AS doc, number, l_partkey % 4 AS kind, chr((65 + l_partkey % 5)::INT) AS letter, l_suppkey % 5 = 0 AS twice, l_suppkey % 7 = 0 AS early, l_suppkey % 97 = 0 AS no FROM n),
a AS (SELECT doc, number, letter, CASE WHEN kind < 2 THEN 2 WHEN early THEN 4 ELSE 3 END AS turn FROM q WHERE NOT no UNION ALL SELECT doc, number, 'E', 3 FROM q WHERE kind < 2 AND twice AND NOT no),
f AS (SELECT q.doc, q.number, min(turn) AS first FROM q LEFT JOIN a USING (doc, number) GROUP BY ALL),
s AS (SELECT doc, count(*) AS n_questions, count(first) = count(*) AS complete, max(first) AS stop FROM f GROUP BY doc),
r AS (SELECT a.doc, a.number, complete, arg_max(letter, turn) AS letter FROM a JOIN s USING (doc) WHERE NOT complete OR turn <= stop GROUP BY ALL)"""


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = numbered_lines(spark, sf_dir)
    number, kind = F.col("number"), F.col("l_partkey") % 4
    letter, early, there = F.chr(65 + F.col("l_partkey") % 5), F.col("l_suppkey") % 7 == 0, F.col("l_suppkey") % 97 != 0
    late = F.when(early, 1).otherwise(3)
    piece = lambda when, page, line, ord, text, base, x0: F.when(when & there, F.struct(page.cast("int").alias("page"), line.alias("line"), F.lit(ord).alias("ord"), text.alias("text"), base.cast("double").alias("base"), F.lit(float(x0)).alias("x0"), F.lit(x0 + 12.0).alias("x1")))
    name, y = number.cast("string"), 20 * number
    pieces: list[Column] = [
        piece(kind < 2, F.lit(2), number, 0, F.concat(name, F.lit("  "), letter), y, 100),
        piece((kind < 2) & (F.col("l_suppkey") % 5 == 0), F.lit(3), 1000 + number, 0, F.concat(name, F.lit(" E")), y, 300),
        piece(kind == 2, late, 2000 + number, 0, name, y, 100),
        piece(kind == 2, late, 2000 + number, 1, letter, y, 120),
        piece(kind == 3, late, 3000 + 2 * number, 0, name, y, 200),
        piece(kind == 3, late, 3001 + 2 * number, 0, letter, y + 2, 220),
    ]
    rows = n.select(F.col("l_orderkey").alias("doc"), F.inline(F.array_compact(F.array(*pieces))))
    questions = n.select(F.col("l_orderkey").alias("doc"), "number")
    pages = questions.select("doc").distinct().select("doc", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("page"))
    turns = answers.key_pages(pages, questions.select("doc", F.lit(1).alias("page")))
    return answers.answer_keys(questions, turns, answers.page_answers(rows))


@query(f"""{_KEYS}
SELECT doc, printf('%02d', number) AS number, letter FROM r WHERE complete""")
def answer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir)[0]


@query(f"""{_KEYS}
SELECT s.doc, n_questions, coalesce(n, 0) AS n_read, complete FROM s LEFT JOIN (SELECT doc, count(*) AS n FROM r GROUP BY doc) c ON c.doc = s.doc""")
def answer_key_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir)[1]


@query(f"""
WITH {_N}, f AS (SELECT l_orderkey AS page, number AS ord, 100.0 + 60 * (number % 3) AS x0, 90.0 * (number // 3) AS y0, 20.0 + l_partkey % 50 AS h FROM n),
p AS (SELECT l_orderkey AS page, chr((65 + l_suppkey % 6)::INT) AS letter, 100.0 + 60 * (number % 3) - (l_partkey % 60 - 10) AS x1, 90.0 * (number // 3) + l_suppkey % 80 - 24 AS y FROM n),
m AS (SELECT f.page, ord, letter, abs(f.x0 - x1) + abs(y - y0) AS d FROM f JOIN p USING (page) WHERE letter <= 'E' AND f.x0 - x1 BETWEEN -4 AND 40 AND y BETWEEN y0 - 14 AND y0 + 0.6 * h)
SELECT f.page, f.ord, (SELECT letter FROM m WHERE m.page = f.page AND m.ord = f.ord ORDER BY d, letter LIMIT 1) AS letter FROM f""")
def figure_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = numbered_lines(spark, sf_dir).select("*", F.lit(1).alias("doc"), F.col("l_orderkey").alias("page"), (100.0 + 60 * (F.col("number") % 3)).alias("x0"), (90.0 * F.floor(F.col("number") / 3)).alias("y0"))
    figures = n.select("doc", "page", F.col("number").alias("ord"), "x0", "y0", (F.col("x0") + 50).alias("x1"), (F.col("y0") + 20 + F.col("l_partkey") % 50).alias("y1"))
    text = F.concat(F.lit(" "), F.chr(65 + F.col("l_suppkey") % 6), F.when(F.col("l_suppkey") % 2 == 0, ")").otherwise(""))
    pieces = n.select("doc", "page", text.alias("text"), (F.col("x0") - 60).alias("x0"), (F.col("x0") - (F.col("l_partkey") % 60 - 10)).alias("x1"), (F.col("y0") + F.col("l_suppkey") % 80 - 20).alias("base"), F.lit(10.0).alias("height"))
    return answers.figure_letters(figures, pieces).select("page", "ord", "letter")


@query(f"""
WITH {_N}, m AS (SELECT l_orderkey AS page, number AS ord, 30.0 * number + l_partkey % 40 AS y0, 30.0 * number + l_partkey % 40 + l_suppkey % 30 AS y1 FROM n),
l AS (SELECT l_orderkey AS page, number AS line, 30.0 * number AS a, 30.0 * number + 10 + l_suppkey % 15 AS b FROM n),
h AS (SELECT m.page, ord, line, least(y1, b) - greatest(y0, a) AS s FROM m JOIN l USING (page) WHERE least(y1, b) - greatest(y0, a) >= 0.5 * (b - a) OR (least(y1, b) > greatest(y0, a) AND (a + b) / 2 > y0 AND (a + b) / 2 < y1))
SELECT m.page, m.ord, (SELECT line FROM h WHERE h.page = m.page AND h.ord = m.ord ORDER BY s DESC, line LIMIT 1) AS line FROM m""")
def host_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = numbered_lines(spark, sf_dir).select("*", F.lit(1).alias("doc"), F.col("l_orderkey").alias("page"), (30.0 * F.col("number")).alias("at"))
    top = F.col("at") + F.col("l_partkey") % 40
    marks = n.select("doc", "page", F.col("number").alias("ord"), top.alias("y0"), (top + F.col("l_suppkey") % 30).alias("y1"))
    lines = n.select("doc", "page", F.col("number").alias("line"), F.col("at").alias("y0"), (F.col("at") + 10 + F.col("l_suppkey") % 15).alias("y1"))
    return answers.host_lines(marks, lines).select("page", "ord", "line")


@query("""
WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l, doc_id % 4 AS k FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_concat(l[:k], ['⟦A⟧', '⟦B⟧'], l[k + 1:k + 1], ['⟦C⟧'], l[k + 2:], ['⟦D⟧']), chr(10)) AS text FROM x WHERE len(l) > k + 1
UNION ALL SELECT doc_id, array_to_string(list_concat(l[:k], ['⟦A⟧', '⟦B⟧'], l[k + 1:], ['⟦C⟧', '⟦D⟧']), chr(10)) FROM x WHERE len(l) <= k + 1""")
def marks_in_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two marks before one line, one before the next, one past the end; places are those of the unmarked text."""
    k = (F.col("doc_id") % 4).cast("int")
    marks = F.array(*[F.struct(at.cast("int").alias("at"), F.lit(text).alias("text")) for at, text in ((k, "⟦A⟧"), (k, "⟦B⟧"), (k + 1, "⟦C⟧"), (F.lit(1 << 30), "⟦D⟧"))])
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(answers.placed_marks(F.split("text", "\n"), marks), "\n").alias("text"))


@query("""
WITH x AS (SELECT doc_id, string_split(text, 'en') AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_transform(p, lambda x, i: CASE WHEN i = 1 THEN x ELSE concat('⟦FÓRMULA Q', doc_id % 40, '_f', i - 1, '⟧', x) END), '') AS text FROM x""")
def marks_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    marked = F.replace("text", F.lit("en"), F.concat(F.lit("⟦FÓRMULA #"), (F.col("doc_id") % 7).cast("string"), F.lit("⟧")))
    return docs.select("doc_id", answers.numbered_marks(marked, F.concat(F.lit("Q"), (F.col("doc_id") % 40).cast("string"), F.lit("_f"))).alias("text"))


@query(r"""
SELECT doc_id, concat('k\frac{q}{', doc_id, '}+\alpha x^{\beta}\sqrt{\pi}\vec {\mu}=\hat{', lang, '}') AS lean FROM documents""")
def formulas_lean(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    read = F.concat(F.lit(r"k{\frac{q}{"), i, F.lit(r"}}+{\alpha} x^{\beta}\sqrt{{\pi}}\vec {\mu}={\hat{"), F.col("lang"), F.lit("}}"))
    return table(spark, sf_dir, "documents").select("doc_id", t.lean_braces(read).alias("lean"))
