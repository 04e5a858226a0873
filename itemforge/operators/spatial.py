"""Joins by place: last before, inside, nearest, most overlap.

Each has equality keys (document and page, user, order) that bound what meets. What is
asked of the rows before a place is a running maximum over one sort; other conditions on
places are part of the join, so Spark sees an equi-join with a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _so_far(left: DataFrame, right: DataFrame, keys: list[str], at: str, place: str, found: Column, out: str) -> DataFrame:
    """left with the greatest `found` of the right rows at or before its place. Both sides
    are sorted once within keys, so a hot key costs a sort and no pairs."""
    rows = left.withColumn("_p", F.col(at)).withColumn("_mine", F.lit(True))
    rows = rows.unionByName(right.select(*keys, F.col(place).alias("_p"), found.alias("_x")), allowMissingColumns=True)
    best = F.max("_x").over(Window.partitionBy(*keys).orderBy("_p"))  # with all rows at the same place
    return rows.withColumn(out, best).where("_mine").select(*left.columns, out)


def last_before(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, value: str, rank: str, out: str) -> DataFrame:
    """left with the value of the greatest rank among right rows that start at or before
    `at`; null without one."""
    found = _so_far(left, right, keys, at, start, F.struct(F.col(rank).alias("r"), F.col(value).alias("v")), out)
    return found.withColumn(out, F.col(out)["v"])


def nearest_before(left: DataFrame, right: DataFrame, keys: list[str], at: str, place: str, reach: float, value: str, out: str) -> DataFrame:
    """left with the value (a number; of equally near ones the smallest) of the right row
    nearest at or before `at` and at most `reach` away; null without one."""
    found = _so_far(left, right, keys, at, place, F.struct(F.col(place).alias("p"), (-F.col(value)).alias("v")), out)
    return found.withColumn(out, F.when(F.col(at) - F.col(out)["p"] <= reach, -F.col(out)["v"]))


def inside(points: DataFrame, boxes: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """Pairs of a point and a box (x0, y0, x1, y1) that holds it."""
    return points.withColumn("_x", x).withColumn("_y", y).join(boxes, keys).where("_x between x0 and x1 and _y between y0 and y1").drop("_x", "_y")


def outside_all(items: DataFrame, boxes: DataFrame, keys: list[str], left_slack: float = 6, bottom_slack: float = 2) -> DataFrame:
    """Items (x0, y0, x1, y1) whose centre line lies in none of the boxes, with some
    room to the left, and to the right a share of the box's width."""
    b = boxes.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    on = F.lit(True)
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    centre = (F.col("y0") + F.col("y1")) / 2
    on &= (F.col("x0") >= F.col("_x0") - left_slack) & (F.col("x1") <= F.col("_x1") + F.greatest(F.lit(8.0), 0.08 * (F.col("_x1") - F.col("_x0"))))
    on &= centre.between(F.col("_y0"), F.col("_y1") + bottom_slack)
    return items.join(b, on, "left_anti")


def owner(strays: DataFrame, parts: DataFrame, keys: list[str], row: list[str]) -> DataFrame:
    """The part a stray belongs to: the lowest that begins above its centre (2 points
    of slack), else the first. parts: keys, part, y0, ord."""
    near = strays.join(parts.select(*keys, "part", F.col("y0").alias("_py"), "ord"), keys)
    above = (F.col("y0") + F.col("y1")) / 2 >= F.col("_py") - 2
    return near.groupBy(*row).agg(F.coalesce(F.max_by(F.when(above, F.col("part")), F.when(above, F.struct("_py", -F.col("ord")))), F.min_by("part", "ord")).alias("part"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], distance: Column, allowed: Column, row: list[str], value: str, tie: str, out: str) -> DataFrame:
    """The value of the nearest allowed right row of each left row, null without one."""
    hits = left.join(right, keys).where(allowed).groupBy(*row).agg(F.min_by(value, F.struct(distance.alias("d"), F.col(tie).alias("t"))).alias(out))
    return left.select(*row).join(hits, row, "left")


def most_overlap(left: DataFrame, right: DataFrame, keys: list[str], row: list[str], value: str, out: str, lo: str = "lo", hi: str = "hi", least: float = 0.0, side: float = 20.0) -> DataFrame:
    """The right interval (r_lo, r_hi) with which each left one (lo, hi) shares most,
    if it is more than `least` (0 or more); ties go to the smallest value. Left outer.

    Intervals meet by bins of `side`, about the length of one, so a key with many isn't squared. Those that
    share two bins meet twice, which changes neither the best nor how much it shares."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / side), F.floor(F.greatest(F.col(a), F.col(b)) / side)))
    cut, met = left.withColumn("_bin", bins(lo, hi)), right.withColumn("_bin", bins("r_lo", "r_hi"))
    hits = cut.join(met, [*keys, "_bin"]).withColumn("_o", F.least(hi, "r_hi") - F.greatest(lo, "r_lo")).where(F.col("_o") > least)
    hits = hits.groupBy(*row).agg(F.min_by(value, F.struct((-F.col("_o")).alias("o"), F.col(value).alias("v"))).alias(out), F.max("_o").alias("overlap"))
    return left.select(*row).join(hits, row, "left")
