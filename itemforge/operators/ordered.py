"""Operators on ordered rows: carried headers, regions, groups by gap and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once


def _upto(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def carry_down(df: DataFrame, keys: list[str], order: list, value: Column, out: str) -> DataFrame:
    """The last value that isn't null, so far."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(_upto(keys, order)))


def region_end(df: DataFrame, keys: list[str], start: str, bottom: Column, out: str = "y_end", gap: float = 2.0) -> DataFrame:
    """Where a region that begins at start ends: before the next in its column, else at the bottom."""
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy(start))
    return df.withColumn(out, F.coalesce(following, bottom) - gap)


def gap_groups(df: DataFrame, keys: list[str], position: Column, order: list, most: float, out: str = "group_no") -> DataFrame:
    """Numbers groups whose neighbours are at most `most` apart."""
    before = F.lag(position).over(Window.partitionBy(*keys).orderBy(*order))
    df = df.withColumn("_opens", F.coalesce((position - before > most).cast("int"), F.lit(1)))
    return df.withColumn(out, F.sum("_opens").over(_upto(keys, order))).drop("_opens")


def runs(df: DataFrame, keys: list[str], value: str, order: list, out: str = "run_no") -> DataFrame:
    """Numbers the runs of equal values."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    df = df.withColumn("_opens", (first | ~F.col(value).eqNullSafe(before)).cast("int"))
    return df.withColumn(out, F.sum("_opens").over(_upto(keys, order))).drop("_opens")


def anchor_groups(df: DataFrame, keys: list[str], position: str, order: list[str], reach: float, out: str = "line_no") -> DataFrame:
    """Numbers groups of rows less than `reach` from their group's first. Unlike
    gap_groups() the distance is to the anchor, so a chain of small steps splits.

    One fold per key over its sorted rows: a key should be a page, not a table.
    """
    item = F.struct(*order, *[c for c in df.columns if c not in keys and c not in order])
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("numbers"))

    def step(acc: Column, x: Column) -> Column:
        same = F.coalesce(F.abs(x[position].cast("double") - acc["anchor"]) < reach, F.lit(False))
        n = F.when(same, acc["n"]).otherwise(acc["n"] + 1)
        return F.struct(F.when(same, acc["anchor"]).otherwise(x[position].cast("double")).alias("anchor"), n.alias("n"), F.concat(acc["numbers"], F.array(n)).alias("numbers"))

    rows = rows.withColumn("_n", F.aggregate("_rows", start, step)["numbers"])
    rows = rows.select(*keys, F.explode(F.arrays_zip("_rows", "_n")).alias("_x"))
    return rows.select(*keys, "_x._rows.*", F.col("_x._n").alias(out))


def anchored(rows: Column, position: str, reach: float) -> Column:
    """The groups of anchor_groups() as arrays, of rows that are an array of structs in order already (by position first). The
    fold carries only where groups begin: they are slices."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("at"))

    def step(a: Column, x: Column) -> Column:
        same = F.coalesce(F.abs(x["p"] - a["anchor"]) < reach, F.lit(False))
        return F.when(same, a).otherwise(F.struct(x["p"].alias("anchor"), F.concat(a["at"], F.array(x["i"])).alias("at")))

    def groups(r: Column) -> Column:
        places = F.transform(r, lambda x, i: F.struct(x[position].cast("double").alias("p"), (i + 1).alias("i")))
        cut = lambda at: F.transform(at, lambda i, k: F.slice(r, i, F.coalesce(F.get(at, k + 1), F.size(r) + 1) - i))
        return once(F.aggregate(places, start, step, lambda a: a["at"]), cut)

    return once(rows, groups)


def bands(df: DataFrame, keys: list[str], y0: str = "y0", y1: str = "y1", order: list[str] | None = None, out: str = "band") -> DataFrame:
    """Numbers bands of rectangles, top to bottom: one joins the last band if it
    overlaps it by half the smaller height or more. A fold per key, as anchor_groups()."""
    order = order or [y0]
    item = F.struct(*order, *[c for c in df.columns if c not in keys and c not in order])
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    start = F.struct(F.lit(None).cast("double").alias("bottom"), F.lit(0.0).alias("height"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("numbers"))

    def step(acc: Column, x: Column) -> Column:
        tall = x[y1] - x[y0]
        same = F.coalesce(x[y0] < acc["bottom"] - 0.5 * F.least(tall, acc["height"]), F.lit(False))
        n = F.when(same, acc["n"]).otherwise(acc["n"] + 1)
        return F.struct(F.when(same, F.greatest(acc["bottom"], x[y1])).otherwise(x[y1]).alias("bottom"), F.when(same, acc["height"]).otherwise(tall).alias("height"), n.alias("n"), F.concat(acc["numbers"], F.array(n)).alias("numbers"))

    rows = rows.withColumn("_n", F.aggregate("_rows", start, step)["numbers"])
    rows = rows.select(*keys, F.explode(F.arrays_zip("_rows", "_n")).alias("_x"))
    return rows.select(*keys, "_x._rows.*", F.col("_x._n").alias(out))


def banded(rows: Column, kind: str, y0: str = "y0", y1: str = "y1", out: str = "band") -> Column:
    """The rows of bands() that are a sorted array of structs (kind, a DDL type) already, each with its band."""
    numbered = f"{kind[:-1]}, {out}: int>"
    start = F.struct(F.lit(None).cast("double").alias("bottom"), F.lit(0.0).alias("height"), F.lit(0).alias("n"), F.array().cast(f"array<{numbered}>").alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        tall = x[y1] - x[y0]
        same = F.coalesce(x[y0] < acc["bottom"] - 0.5 * F.least(tall, acc["height"]), F.lit(False))
        n = F.when(same, acc["n"]).otherwise(acc["n"] + 1)
        return F.struct(F.when(same, F.greatest(acc["bottom"], x[y1])).otherwise(x[y1]).alias("bottom"), F.when(same, acc["height"]).otherwise(tall).alias("height"), n.alias("n"), F.concat(acc["rows"], F.array(x.withField(out, n))).alias("rows"))

    return F.aggregate(rows, start, step, lambda acc: acc["rows"])


def buckets(df: DataFrame, keys: list[str], order: list, size: int, out: str = "part") -> DataFrame:
    """Numbers parts of `size` rows within keys, from 0."""
    return df.withColumn(out, F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size).cast("int"))


def best_reading(readings: DataFrame, keys: list[str], reading: str, rarity: Column, mean: str) -> DataFrame:
    """The reading of each key by votes, then the least rare, then the best mean score."""
    voted = readings.groupBy(*keys, reading).agg(F.count(F.lit(1)).alias("votes"), F.max(mean).alias("best"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), rarity, F.desc("best"), reading))
    return voted.withColumn("_r", rank).where("_r = 1").drop("_r")


def majority(df: DataFrame, keys: list[str], vote: Column) -> DataFrame:
    """Whether more than half of a key's votes (nulls don't vote) are for it."""
    return df.groupBy(*keys).agg(F.count(vote).alias("votes"), F.count_if(vote).alias("ayes")).withColumn("carried", F.col("ayes") * 2 > F.col("votes"))


def weighted_rank_value(df: DataFrame, keys: list[str], value: str, weight: str, share: float, out: str = "value_at") -> DataFrame:
    """The value at index floor(share * n) of a key's values, each repeated weight times."""
    per = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    cumulative = F.sum("_w").over(_upto(keys, [value]))
    total = F.sum("_w").over(Window.partitionBy(*keys))
    per = per.withColumn("_c", cumulative).withColumn("_n", F.floor(total * share))
    return per.where("_c > _n").groupBy(*keys).agg(F.min(value).alias(out))


def top_margin(scores: DataFrame, keys: list[str], value: str, score: str) -> DataFrame:
    """(keys, value, score, margin): the value with the best score of each key and how far
    the next value lies behind; of a value's own scores the best counts. No sort: the two
    best are found by partial aggregates."""
    best = scores.groupBy(*keys, value).agg(F.max(score).alias("_s"))
    two = F.slice(F.sort_array(F.collect_list(F.struct("_s", F.col(value).alias("_v"))), asc=False), 1, 2)
    out = best.groupBy(*keys).agg(two.alias("_t"))  # the values of a key are a few letters
    top, next_ = F.get("_t", F.lit(0)), F.get("_t", F.lit(1))
    return out.select(*keys, top["_v"].alias(value), top["_s"].alias(score), (top["_s"] - next_["_s"]).alias("margin"))


def word_cuts(gaps: Column, words: Column, least: float = 2.0, ratio: float = 1.15) -> Column:
    """The gaps (an array) that part `words` words, largest first; null where they are too
    few, too small or hardly larger than the next."""
    ranked = F.sort_array(gaps, asc=False)
    cuts, rest = F.slice(ranked, F.lit(1), F.greatest(words - 1, F.lit(0))), F.coalesce(F.get(ranked, words - 1), F.lit(0.0))
    clear = (words == 1) | ((F.array_min(cuts) >= least) & (F.array_min(cuts) >= ratio * rest))
    return F.when((words >= 1) & (F.size(cuts) == words - 1) & clear, cuts)


def first_valid(tries: DataFrame, keys: list[str], order: str, valid: Column, value: str) -> DataFrame:
    """(keys, value): the first try of each key that is valid, null without one."""
    return tries.groupBy(*keys).agg(F.min_by(value, F.when(valid, F.col(order))).alias(value))
