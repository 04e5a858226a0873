"""Queries of whole segments, from text items, formulas and figures to the texts of questions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matrix import matrix
from ..operators import segment, whole
from .queries import _N, numbered_lines, query

# An order is a document of one page, a line item a question on it: its bar, three lines, and by supplier a formula in the
# first line, one between the first two, a brace before both, or a figure below with or without its letter.
_Q = f"""
WITH {_N}, q AS (SELECT l_orderkey AS doc, number, 100.0 * number AS y, l_partkey % 10 AS p, l_partkey % 2 = 0 AS bold, l_partkey % 3 = 0 AS mid, l_suppkey % 4 AS v, l_suppkey % 3 = 0 AS bare, printf('Q%02d', number) AS name FROM n)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of the stand-ins with what they hold (c); line items come together by order only once."""
    n = numbered_lines(spark, sf_dir).withColumn("y", 100.0 * F.col("number")).withColumn("v", F.col("l_suppkey") % 4)
    at, p, v, bare = F.col("y"), F.col("l_partkey"), F.col("v"), F.col("l_suppkey") % 3 == 0

    def item(j: int, text: Column, x: float, width: Column, y: Column, bold: Column | None = None) -> Column:
        of = {"ord": 10 * F.col("number") + j, "text": text, "matrix": matrix(1, 0, 0, 1, F.lit(x), y), "width": width.cast("double"), "height": F.lit(10.0), "font": F.lit("F"), "bold": F.lit(False) if bold is None else bold}
        return F.struct(*[c.alias(k) for k, c in of.items()])

    mark = F.when(bare, "e").otherwise("E)")
    six = [
        item(0, F.concat(F.lit("Questão "), F.col("number").cast("string")), 40.0, F.lit(60), at + 10),
        item(1, F.lit("alfa"), 40.0, F.lit(8), at + 30, p % 2 == 0),
        item(2, F.lit("y ≥ 2"), 78.0, F.lit(30), at + 30),
        item(3, F.concat(F.lit("x = "), (p % 10).cast("string")), 60.0, F.when(p % 3 == 0, 120).otherwise(30), at + 50),
        item(4, F.lit("delta"), 40.0, F.when(v == 3, 100).otherwise(160), at + 70),
        item(5, F.when(v == 3, mark).otherwise(""), 190.0, F.lit(10), at + 70),
    ]
    box = lambda x0, y0, x1, y1: [F.lit(c).cast("double").alias(k) for c, k in zip((x0, at + y0, x1, at + y1), whole.BOX, strict=True)]
    by = lambda *of: F.when(v == 0, float(of[0])).when(v == 1, float(of[1])).otherwise(float(of[2]))
    ink = F.when(v < 3, F.struct(*box(by(72, 110, 50), by(20, 34, 22), by(77, 130, 56), by(32, 39, 50)), F.lit(False).alias("image")))
    left = F.when(bare, 275.0).otherwise(220.0)
    image = F.when(v == 3, F.struct(F.col("number").cast("long").alias("ord"), *box(left, F.lit(62.0), left + 50, F.lit(96.0))))
    held = n.groupBy(F.col("l_orderkey").alias("doc")).agg(F.flatten(F.collect_list(F.array(*six))).alias("items"), F.collect_list(ink).alias("inks"), F.collect_list(image).alias("images"), F.max("y").alias("_y"))
    page = {"page": F.lit(1), "view": matrix(1, 0, 0, 1, 0, 0), "width": F.lit(600.0), "height": F.col("_y") + 140, "one_column": F.lit(True), "bottom": F.col("_y") + 100}
    return segment.assign_questions(whole.page_parts(held.withColumns(page)))


@query(rf"""{_Q},
x AS (SELECT *, CASE WHEN bold THEN '**alfa**' ELSE 'alfa' END AS alfa, CASE WHEN mid THEN '[centralizado] ' ELSE '' END || 'x = ' || p AS second,
  '\begin{{cases}} y \ge 2 \\ x = ' || p || ' \end{{cases}}' AS latex, 'Questão ' || number || chr(10) AS bar FROM q)
SELECT doc, number AS question, CASE v
  WHEN 0 THEN bar || alfa || ' ⟦FÓRMULA ' || name || '_f1⟧ y ≥ 2' || chr(10) || second || chr(10) || 'delta'
  WHEN 1 THEN bar || alfa || ' y ≥ 2' || chr(10) || '[centralizado] ⟦FÓRMULA ' || name || '_f1⟧' || chr(10) || second || chr(10) || 'delta'
  WHEN 2 THEN bar || alfa || ' ⟦FÓRMULA ' || name || '_f1 = $' || latex || '$⟧' || chr(10) || chr(10) || 'delta'
  ELSE bar || alfa || ' y ≥ 2' || chr(10) || second || chr(10) || CASE WHEN bare THEN '⟦FIGURA ' || name || '_fig1⟧' || chr(10) || 'delta e' ELSE 'delta E)' || chr(10) || '⟦FIGURA ' || name || '_fig1⟧' END END AS text,
  CASE WHEN v < 3 THEN name || '_f1:' || CASE WHEN v = 2 THEN latex ELSE '' END ELSE '' END AS formulas, CASE WHEN v < 3 THEN '' WHEN bare THEN name || '_fig1:3::true' ELSE name || '_fig1:4:E:false' END AS figures FROM x""")
def question_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir).where("question is not null")
    q = whole.question_rows(parts.select("doc", "question", "ord", "c.lines", "c.formulas", "c.figures"))
    said = lambda *of: F.array_join(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in of]), ":")
    formulas = F.transform("formulas", lambda f: said(f["name"], f["of"]["latex"]))
    figures = F.transform("figures", lambda f: said(f["name"], f["of"]["at"], f["of"]["letter"], f["of"]["centred"]))
    return q.select("doc", "question", "text", F.array_join(formulas, ",").alias("formulas"), F.array_join(figures, ",").alias("figures"))


@query(f"""{_Q}
SELECT doc, number AS part, CAST(CASE WHEN v = 1 THEN 5 ELSE 4 END AS BIGINT) AS n_lines, y - 2 AS y0, least(y + 98, CASE WHEN v = 3 THEN y + 104 ELSE y + 80.5 END) AS y1 FROM q""")
def segment_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("doc", F.col("ord").alias("part"), F.size("c.lines").cast("long").alias("n_lines"), F.col("c.top").alias("y0"), F.col("c.end").alias("y1"))
