"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_crc32

#: Rows that one sort task of a bucket should get, about.
ROWS_PER_BUCKET = 50_000


def _ranked(df: DataFrame, keys: list[str], bucket: Column, order: list, out: str) -> DataFrame:
    """Adds out, the 0-based rank of each row within keys by (bucket, order).

    bucket must rise with order. Rows are ranked inside their bucket, and the
    buckets before it are counted: the counts are one row per (keys, bucket),
    so no task ever gets all rows of a hot key.
    """
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_kb"), F.coalesce(before, F.lit(0)).alias("_before"))
    on = F.col("_bucket") == F.col("_kb")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    return df.join(counts, on).withColumn(out, F.col("_before") + rank).drop("_bucket", "_before", "_kb", *[f"_k{i}" for i in range(len(keys))])


def shard_stratified(docs: DataFrame, n_shards: int = 24, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source") -> DataFrame:
    """Deals the rows of docs to n_shards so that each shard has the mixture of
    strata of the whole.

    The rows of a stratum are put in a seeded random order (md5 of seed and id,
    as hex) and get the fractional rank (rank + 0.5) / rows of the stratum. All
    rows sorted by fractional rank, stratum, hash interleave the strata in
    proportion; that order is cut into n_shards runs whose lengths differ by one
    at most (law `rows`), and slot counts from 0 in a run.

    Returns (doc_id, size, text_crc32, law, shard, slot, grown_shard, source),
    one row per input row; grown_shard is null, as rows move under this law.
    A null stratum is a stratum of its own. A null text has size 8 and crc 0.
    A null id is hashed as the word null. Ties (a repeated id) are broken by the
    crc and size; rows alike in all of these are interchangeable. An empty table
    gives no rows. Other columns of docs are ignored.
    """
    n = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("source"), n.alias("size"), text_crc32(F.col(text_col)).alias("text_crc32"), h.alias("_h"))
    rows = materialize(rows, "shard")
    # One row per stratum.
    strata = rows.groupBy("source").agg(F.count(F.lit(1)).alias("_rows"))
    total = rows.count()
    n_buckets = 4 * max(1, -(-total // ROWS_PER_BUCKET))
    by_hash = F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * n_buckets)
    tie = ["_h", "doc_id", "text_crc32", "size"]
    ranked = _ranked(rows, ["source"], by_hash, tie, "_r")
    strata = strata.select(F.col("source").alias("_s"), "_rows")
    ranked = ranked.join(strata, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    ranked = ranked.withColumn("_f", (F.col("_r") + 0.5) / F.col("_rows")).drop("_r", "_rows").withColumn("_all", F.lit(0))
    placed = _ranked(ranked, ["_all"], F.floor(F.col("_f") * n_buckets * 2), ["_f", "source", *tie], "_g")
    placed = placed.withColumn("shard", F.expr(f"(_g * {n_shards}) div {max(1, total)}").cast("int"))
    first = F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_g") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source")
