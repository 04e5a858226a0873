"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of
    the session. Where it is unset, local mode makes and sets one; on a cluster, whose
    executors don't see the driver's folders, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back. It cuts the
    lineage, and the copy outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, or a longer one, that no column of df has (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def worker_store(name: str) -> dict:
    """A dict that outlives the task in its Python worker process, for tables which
    are costly to build and memos which later tasks can use again. Shipped
    functions have fresh globals in each task, so it hangs on sys.modules. A worker
    holds one store: a task that asks for another, or for none (""), frees what
    earlier operators left."""
    home = sys.modules.setdefault("_itemforge_worker", types.ModuleType("_itemforge_worker"))
    stores = home.__dict__.setdefault("stores", {})
    for other in [k for k in stores if k != name]:
        del stores[other]
    return stores.setdefault(name, {})


#: Bytes that a worker's memo may hold, about.
MEMO_BYTES = 192 << 20
#: What an entry of a memo takes besides its letters and ids, about.
ENTRY_BYTES = 200


class Memo:
    """Results (bytes) by text, about MEMO_BYTES of them at most, in two generations of
    half of it each. What is asked for is in the young one or moves there; when that is
    full it becomes the old one, and the old one goes with what nobody asked for since."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def turn(self) -> None:
        """To be called between two batches: all that a batch asked for or kept is in `young` until then."""
        if self.held > MEMO_BYTES // 2:
            self.old, self.young, self.held = self.young, {}, 0

    def keep(self, key: str, value: bytes) -> None:
        self.young[key] = value
        self.held += ENTRY_BYTES + len(key) + len(value)

    def keep_all(self, keys: list[str], values: list[bytes]) -> None:
        self.young.update(zip(keys, values))
        self.held += ENTRY_BYTES * len(keys) + sum(map(len, keys)) + sum(map(len, values))

    def unknown(self, keys: Iterable[str]) -> list[str]:
        """Those of keys (each of them once) that are to be learned."""
        young, old, new = self.young, self.old, []
        for k in keys:  # a set difference would walk the whole memo
            if k not in young:
                if (v := old.get(k)) is None:
                    new.append(k)
                else:
                    self.keep(k, v)
        return new


def text_crc32(col):
    return F.crc32(F.coalesce(col, F.lit("")).cast("binary"))


def _mark(h: Column) -> Column:
    """Three bits of 64 (fewer where they meet) that stand for a hash in its word of a
    filter; they come from other bits of the hash than the word does."""
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftright(h, k).bitwiseAND(F.lit(63)).cast("int")) for k in (40, 46, 52)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def hash_filter(hashes: DataFrame, bits: int) -> Callable[[Column], Column]:
    """A test whether a 64-bit hash may be among hashes (one long column): never wrong
    about those that are, and rarely about others. bits, a power of two, is its size,
    which doesn't grow with the data; what passes still goes through an exact join.
    A hash has all its bits in one word, so words are sums that combine before the
    shuffle, and a test names the array of words, which each task gets, once."""
    words = bits // 64
    h = F.col(hashes.columns[0])
    word = lambda h: h.bitwiseAND(F.lit(words - 1).cast("long"))
    marks = hashes.where(h.isNotNull()).select(word(h).alias("w"), _mark(h).alias("v"))
    every = hashes.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("v"))
    summed = marks.unionByName(every).groupBy("w").agg(F.bit_or("v").alias("v"))
    dense = summed.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("words")).scalar()
    return lambda h: F.bitwise_not(F.get(dense, word(h).cast("int"))).bitwiseAND(_mark(h)) == 0


def filter_size(n: int, least: int = 1 << 16, most: int = 1 << 25) -> int:
    """Bits of a filter for n hashes, at most `most` (4 MB): a fuller one only lets more pass."""
    return min(most, max(least, 1 << (16 * max(1, n) - 1).bit_length()))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of edges(a, b); comp is the least node it is
    connected with. Alternates large-star and small-star steps, which need
    O(log n) rounds on chains and never gather a component in one task: each
    step is a min per node (combined before the shuffle) and a join on node,
    where AQE splits hot nodes. Each round is written to the shared folder; the last is
    the one that leaves nothing but stars around least nodes. If there is more than that
    after so many rounds, that is an error."""
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    e = edges.where("a <> b").select(hi.alias("a"), lo.alias("b")).distinct()
    e = materialize(e, "cc")
    for _ in range(rounds):
        # Large star: every larger neighbour of a node is tied to the node's least neighbour; a row an edge.
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: the smaller neighbours of a node, and the node, are tied to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x"))
            .select("x.a", "x.b")
            .where("a <> b")
            .distinct()
        )
        e = materialize(small, "cc")
        # Stars: no node has two smaller neighbours, or a smaller and a larger one.
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x"))
        nodes = ends.select("x.*").groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not nodes.agg(F.max((F.col("up") + F.col("down") > 1) & (F.col("up") > 0))).first()[0]:
            break
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
