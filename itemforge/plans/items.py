"""Queries of text items placed by transformations, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matrix import matrix
from ..operators import pieces
from .queries import _N, numbered_lines, query

# An order is a page of one column or two, as it is, larger, or upside down; each line item puts four items on it. How
# far rows lie apart decides whether two of them are a line.
_ITEMS = rf"""
WITH {_N}, g AS (SELECT l_orderkey AS page, number, l_partkey AS p, l_suppkey AS s, (l_orderkey // 3) % 3 AS v, (l_orderkey // 9) % 2 = 0 AS one, count(*) OVER (PARTITION BY l_orderkey) AS n_rows, CASE l_orderkey % 3 WHEN 0 THEN 12 WHEN 1 THEN 1.5 ELSE 2 END AS step FROM n),
i AS (SELECT *, 40.0 AS x, 10 * number AS ord, 'Q' || p % 50 AS t, 30.0 AS w, 9.0 AS h, p % 2 = 0 AS b FROM g
  UNION ALL SELECT *, 70.0 + p % 4, 10 * number + 1, CASE s % 3 WHEN 0 THEN ' e' WHEN 1 THEN 'ou' ELSE '  ' END, 10.0, 5.0, s % 2 = 0 FROM g
  UNION ALL SELECT *, 82.0, 10 * number + 2, 'forte ', 40.0, 8.0, p % 3 = 0 FROM g
  UNION ALL SELECT *, 340.0, 10 * number + 3, 'r' || s, 0.0, 11.0, false FROM g),
q AS (SELECT *, CASE v WHEN 0 THEN x WHEN 1 THEN 1.5 * x ELSE 600 - x END AS x0, CASE v WHEN 0 THEN 100 + step * number WHEN 1 THEN 150 + 1.5 * step * number ELSE 700 - step * number END AS base,
  CASE WHEN v = 2 THEN n_rows - number ELSE number - 1 END AS nth, step * CASE WHEN v = 1 THEN 1.5 ELSE 1 END >= 2.5 AS alone FROM i),
l AS (SELECT *, x0 + w AS x1, CASE WHEN NOT one AND x0 >= CASE WHEN v = 1 THEN 450 ELSE 300 END THEN 1 ELSE 0 END AS col, 1 + CASE WHEN alone THEN nth ELSE nth // 2 END AS line_no FROM q),
o AS (SELECT *, row_number() OVER w AS k, lag(x1) OVER w AS e, lag(t) OVER w AS before FROM l WINDOW w AS (PARTITION BY page, col, line_no ORDER BY x0, base, ord)),
d AS (SELECT * EXCLUDE (t), CASE WHEN (x0 - e > 1.5 OR e - x0 > 1) AND NOT ends_with(before, ' ') AND NOT starts_with(t, ' ') THEN ' ' || t ELSE t END AS t, trim(t) <> '' AS word FROM o),
w1 AS (SELECT *, CASE WHEN word THEN b OR (length(trim(t)) <= 3 AND coalesce(lag(b) OVER w AND lead(b) OVER w, false)) ELSE b END AS b1, count(*) FILTER (WHERE word) OVER (PARTITION BY page, col, line_no ORDER BY k) AS run FROM d WINDOW w AS (PARTITION BY page, col, line_no, word ORDER BY k)),
w2 AS (SELECT *, CASE WHEN word THEN b1 ELSE coalesce(lead(b1) OVER (PARTITION BY page, col, line_no ORDER BY k), false) END AS b2 FROM w1),
w3 AS (SELECT *, CASE WHEN word THEN b1 ELSE run > 0 AND bool_and(b2) OVER (PARTITION BY page, col, line_no, run ORDER BY k) END AS bold FROM w2),
r AS (SELECT *, k - row_number() OVER (PARTITION BY page, col, line_no, bold ORDER BY k) AS part FROM w3),
m AS (SELECT page, col, line_no, bold, min(k) AS k, string_agg(t, '' ORDER BY k) AS t, count(*) AS n, min(x0) AS x0, max(x1) AS x1, min(base) AS base, max(h) AS h FROM r GROUP BY page, col, line_no, bold, part)
SELECT page, col, line_no, string_agg(t, '' ORDER BY k) AS text, string_agg(CASE WHEN bold AND regexp_matches(t, '[0-9A-Za-zÀ-ú]') THEN regexp_replace(t, '(?s)^(\s*)(.*?)(\s*)$', '\1**\2**\3') ELSE t END, '' ORDER BY k) AS marked,
  CAST(sum(n) AS BIGINT) AS n_pieces, CAST(min(x0) AS DOUBLE) AS x0, CAST(min(base) - max(h) AS DOUBLE) AS y0, CAST(max(x1) AS DOUBLE) AS x1, CAST(min(base) + 0.25 * max(h) AS DOUBLE) AS y1 FROM m GROUP BY page, col, line_no"""


@query(_ITEMS)
def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = numbered_lines(spark, sf_dir)
    page, number, p, s = F.col("l_orderkey"), F.col("number"), F.col("l_partkey"), F.col("l_suppkey")
    y = 700 - number * F.when(page % 3 == 0, 12.0).when(page % 3 == 1, 1.5).otherwise(2.0)

    def item(j: int, text: Column, x: Column, width: float, height: float, bold: Column, c: float = 0, d: float = 0) -> Column:
        of = {"ord": 10 * number + j, "text": text, "matrix": matrix(1, 0, c, d, x, y), "width": F.lit(width), "height": F.lit(height), "font": F.lit("F"), "bold": bold}
        return F.struct(*[v.alias(k) for k, v in of.items()])

    middle = F.when(s % 3 == 0, " e").when(s % 3 == 1, "ou").otherwise("  ")
    four = [
        item(0, F.concat(F.lit("Q"), p % 50), F.lit(40), 30.0, 9.0, p % 2 == 0),
        item(1, middle, 70 + p % 4, 10.0, 0.0, s % 2 == 0, 3, 4),
        item(2, F.lit("forte "), F.lit(82), 40.0, 0.0, p % 3 == 0),
        item(3, F.concat(F.lit("r"), s), F.lit(340), 0.0, 11.0, F.lit(None).cast("boolean")),
    ]
    items = n.select(F.lit(1).alias("doc"), page.alias("page"), F.inline(F.array(*four)))
    v = F.floor(page / 3) % 3
    view = F.when(v == 0, matrix(1, 0, 0, -1, 0, 800)).when(v == 1, matrix(1.5, 0, 0, -1.5, 0, 1200)).otherwise(matrix(-1, 0, 0, 1, 600, 0))
    pages = n.select(F.lit(1).alias("doc"), page.alias("page"), view.alias("view"), F.when(v == 1, 900.0).otherwise(600.0).alias("width"), (F.floor(page / 9) % 2 == 0).alias("one_column")).distinct()
    lines = pieces.piece_lines(pieces.text_pieces(items, pages))
    return lines.select("page", "col", "line_no", "text", "marked", F.size("pieces").cast("long").alias("n_pieces"), "x0", "y0", "x1", "y1")
