"""Prefix trie of conversations from polynomial rolling fingerprints.

Conversations are dealt by ranges of (conversation, place), so the turns of one may lie in
several tasks. Numpy scans give each prefix a fingerprint, a sum of turn hashes times powers of
a base, modulo a prime; what a conversation brings from the task before is carried in. Prefixes
of one depth and fingerprint are a candidate group. Whole turns, together with
the group of the turn before, are then compared with the group's representative, its
least conversation: turns that differ split the group, and all that follows them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: The Mersenne prime 2^61 - 1, the base of the fingerprints, and what parts split turns.
PRIME = (1 << 61) - 1
BASE = 0x15D3A6C1F2B4E897 % PRIME
SPLIT = 0x0F9B8E5D3C7A6142 % PRIME
#: Ids of a piece of a list of ids.
IDS = 256
#: Depths whose sums are one window's work.
BLOCK = 4096


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for arrays of 64-bit integers below it."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & np.uint64((1 << 31) - 1), b >> np.uint64(31), b & np.uint64((1 << 31) - 1)
    mid = a1 * b0 + a0 * b1
    total = ((a1 * b1) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a0 * b0
    return _mod(total)


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def _running(x: np.ndarray) -> np.ndarray:
    """Running sums modulo PRIME, of at most 2^31 values."""
    high, low = np.cumsum(x >> np.uint64(31)), np.cumsum(x & np.uint64((1 << 31) - 1))
    return _mod(_times(_mod(high), np.full(len(x), 1 << 31, np.uint64)) + _mod(low))


def _powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n, or some more."""
    out = np.array([1, BASE], np.uint64)
    while len(out) <= n:
        step = np.uint64(pow(BASE, len(out), PRIME))
        out = np.concatenate([out, _times(out, np.full(len(out), step))])
    return out


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, ord, h, role, text), sorted by (conv_id, ord), get their partition,
    and within it their depth, the fingerprint of their prefix and of the one before. A row
    of a negative ord is the root's: it is no turn."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    powers = _powers(1 << 10)
    last, count, carried = None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column(0).to_numpy()
        turn = batch.column(1).to_numpy() >= 0
        h = batch.column(2).to_numpy().astype(np.uint64)
        new = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        ran = np.cumsum(turn)
        head = conv == last if last is not None else np.zeros(n, bool)
        depth = ran - (ran[start] - turn[start]) + np.where(head, count, 0)
        if depth.max() >= len(powers):
            powers = _powers(int(depth.max()))
        term = np.where(turn, _times(h, powers[depth]), np.uint64(0))
        sums = _running(term)
        before = _mod(sums + np.uint64(PRIME) - term)
        fp = _mod(sums + np.uint64(PRIME) - before[start])
        fp = _mod(fp + np.where(head, np.uint64(carried), np.uint64(0)))
        parent = _mod(fp + np.uint64(PRIME) - term)
        last, count, carried = int(conv[-1]), int(depth[-1]), int(fp[-1])
        columns = [pa.array(np.full(n, part, np.int32)), *[batch.column(k) for k in range(3)], *[pa.array(x.astype(np.int64)) for x in (depth, fp, parent)], batch.column(3), batch.column(4)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "conv_id", "ord", "h", "depth", "fp", "parent", "role", "text"])


def prefixes(turns: DataFrame, order: list[Column], name: str) -> DataFrame:
    """turns (conv_id, ord, h, role, text) with the depth of each turn, counted from 1 in the order of
    (conv_id, order), and the fingerprints of its prefix (fp) and the one before (parent). A conversation
    of any length may lie in many tasks: what it had before a task is carried in, one row for each task at most."""
    spark = turns.sparkSession
    dealt = turns.repartitionByRange("conv_id", order[0]).sortWithinPartitions("conv_id", *order).select("conv_id", "ord", "h", "role", "text")
    local = materialize(dealt.mapInArrow(scan, "part int, conv_id long, ord long, h long, depth long, fp long, parent long, role string, text string"), name)
    ends = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "depth", "fp")).alias("end")).orderBy("part").collect()  # a row a task
    carried, conv, depth, fp = [], None, 0, 0
    for r in ends:
        goes_on = r["first"] == conv
        if goes_on:
            carried.append((r["part"], conv, depth, fp, pow(BASE, depth, PRIME)))
        if not (goes_on and r["end"]["conv_id"] == conv):
            conv, depth, fp = r["end"]["conv_id"], 0, 0
        fp = (fp + pow(BASE, depth, PRIME) * r["end"]["fp"]) % PRIME
        depth += r["end"]["depth"]
    if not carried:
        return local.drop("part")
    before = F.broadcast(spark.createDataFrame(carried, "part int, conv_id long, _depth long, _fp long, _power long"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    moved = lambda c: F.when(F.col("_fp").isNull(), F.col(c)).otherwise(F.pmod(whole("_power") * whole(c) + whole("_fp"), F.lit(PRIME).cast("decimal(38,0)")).cast("long"))
    joined = local.join(before, ["part", "conv_id"], "left")
    return joined.select("conv_id", "ord", "h", (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), moved("fp").alias("fp"), moved("parent").alias("parent"), "role", "text")


def _shared_turns(conv: Column) -> Column:
    """How many turns a conversation has from the first of its twenty."""
    return F.crc32(conv.cast("string")) % 4


def rebuilt(conversations: DataFrame, hash_bits: int = 60) -> DataFrame:
    """(conv_id, ord, h, role, text): the turns of the rebuilt conversations in order, and a row
    of ord -1 for each conversation. h: hash_bits bits of a hash of the turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    h = F.xxhash64("role", "text").bitwiseAND(F.lit((1 << hash_bits) - 1).cast("long"))
    t = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), text("role").alias("role"), text("text").alias("text"))
    t = t.select("conv_id", F.lit(0).cast("long").alias("ord"), h.alias("h"), "role", "text", "_turn")
    t = prefixes(t, [F.col("_turn").asc_nulls_first(), F.col("role"), F.col("text")], "turns")
    t = t.select("conv_id", (F.col("depth") - 1).alias("ord"), "h", "role", "text")
    own = t.where(F.col("ord") >= _shared_turns(F.col("conv_id")))
    roots = t.where("ord = 0").select("conv_id", F.lit(-1).cast("long").alias("ord"), F.lit(0).cast("long").alias("h"), F.lit("").alias("role"), F.lit("").alias("text"))
    # The remainder of a negative id is negative, so 0 has followers on either side.
    firsts = t.where("conv_id % 20 = 0 and ord < 3")
    steps = F.sequence(F.when(F.col("conv_id") > 0, 0).otherwise(-19), F.when(F.col("conv_id") < 0, 0).otherwise(19))
    given = firsts.select(F.explode(steps).alias("_k"), "*").withColumn("conv_id", F.try_add("conv_id", F.col("_k").cast("long"))).drop("_k")
    given = given.where(F.col("ord") < _shared_turns(F.col("conv_id"))).join(roots.select("conv_id"), "conv_id", "left_semi")
    return own.unionByName(given).unionByName(roots)


def verified(turns: DataFrame, rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """The prefixes of turns, and their nodes (depth, fp, parent, conv_id, n_convs, words): no two
    different prefixes of a depth have one fingerprint. Equal turns after equal groups are counted
    together, whole texts compared, before they are shuffled; a group with more than one kind
    has a collision. There each turn that differs from its representative's is given another hash,
    and fingerprints are made again. If collisions are left after `rounds`, that is an error."""
    node, kind = ["depth", "fp"], ["depth", "fp", "parent", "role", "text"]
    for _ in range(rounds):
        rows = prefixes(turns, [F.col("ord")], "prefixes")
        kinds = rows.where("depth > 0").groupBy(*kind).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
        words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
        nodes = materialize(kinds.select("depth", "fp", "parent", "conv_id", "n_convs", words.alias("words")), "nodes")
        met = materialize(nodes.groupBy(*node).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select(*node), "collisions")
        if met.isEmpty():
            return rows, nodes
        apart = rows.join(met, node, "left_semi").groupBy(*kind).agg(F.min("conv_id").alias("least"))
        apart = apart.withColumn("rank", F.row_number().over(Window.partitionBy(*node).orderBy("least")) - 1).where("rank > 0").drop("least")
        dec = lambda c: c.cast("decimal(19,0)")
        changed = F.pmod(dec(F.lit(SPLIT)) * dec(F.coalesce("rank", F.lit(0))) + dec(F.col("h")), F.lit(PRIME).cast("decimal(38,0)")).cast("long")
        turns = rows.join(apart, kind, "left").select("conv_id", "ord", changed.alias("h"), "role", "text")
    raise RuntimeError(f"fingerprints still collide after {rounds} rounds")


def _id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, fp, conv_id) in order: the ids of a node, comma-joined, in pieces."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for (depth, fp), rows in groupby(zip(*[batch.column(k).to_pylist() for k in range(3)]), key=lambda r: r[:2]):
            ids = [r[2] for r in rows]
            for k in range(0, len(ids), IDS):
                for column, v in zip(out, (depth, fp, ids[k], ",".join(map(str, ids[k : k + IDS])))):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())], names=["depth", "fp", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, fp, ids) in order: the SHA-256 of each node's pieces, comma-joined."""
    held, digest = None, hashlib.sha256()
    row = lambda: pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["depth", "fp", "ends_sha256"])
    for batch in batches:
        done = []
        for depth, fp, ids in zip(*[batch.column(k).to_pylist() for k in range(3)]):
            if held == (depth, fp):
                digest.update(b"," + ids.encode())
            else:
                if held is not None:
                    done.append(row())
                held, digest = (depth, fp), hashlib.sha256(ids.encode())
        yield from done
    if held is not None:
        yield row()


def ends_of(rows: DataFrame) -> DataFrame:
    """(depth, fp, ends_sha256) of nodes with which conversations end. The ids of a node are joined
    in pieces by many tasks, so that the one that digests them reads a row for hundreds."""
    ends = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "fp")).alias("e")).select("e.depth", "e.fp", "conv_id")
    pieces = ends.repartitionByRange("depth", "fp", "conv_id").sortWithinPartitions("depth", "fp", "conv_id").mapInArrow(_id_pieces, "depth long, fp long, first long, ids string")
    pieces = pieces.repartition("depth", "fp").sortWithinPartitions("depth", "fp", "first").select("depth", "fp", "ids")
    return pieces.mapInArrow(_digests, "depth long, fp long, ends_sha256 string")


def conversation_trie(conversations: DataFrame, hash_bits: int = 60) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one
    row per node of the prefix trie of the rebuilt conversations.

    A conversation's turns are ordered by turn (null first), ties by role and text. Its first
    h turns are replaced by those of the first conversation of its twenty. Null roles and texts
    are empty; rows without a conv_id belong to no conversation and are left out; other
    columns are ignored. Repeated rows are turns of their own. An empty table has no nodes. Texts
    and conversations may be of any length.

    Sums over subtrees need no walk: each node's part is put on the row of its representative,
    summed from the end of that conversation upwards, and added up per node.
    """
    rows, nodes = verified(rebuilt(conversations, hash_bits))
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    root = rows.where("ord = -1").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("conv_id is not null")
    nodes = nodes.unionByName(root.select(zero.alias("depth"), zero.alias("fp"), none.alias("parent"), "conv_id", "n_convs", zero.alias("words")))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("fp")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["depth", "fp"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = materialize(nodes, "trie-nodes")
    put = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    path = rows.select("conv_id", "depth", "fp").join(put, ["conv_id", "depth"], "left").na.fill(0, ["saved", "leaf"])
    path = materialize(path.withColumn("block", F.floor(F.col("depth") / BLOCK)), "paths")
    up = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = path.groupBy("conv_id", "block").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
    deep = blocks.join(blocks.where("block > 0").select("conv_id").distinct(), "conv_id", "left_semi")
    deep = deep.select("conv_id", "block", F.sum("s").over(below).alias("more_saved"), F.sum("l").over(below).alias("more_leaves"))
    sums = path.select("conv_id", "block", "depth", "fp", F.sum("saved").over(up).alias("saved"), F.sum("leaf").over(up).alias("leaves"))
    sums = sums.join(deep, ["conv_id", "block"], "left").na.fill(0, ["more_saved", "more_leaves"])
    sums = sums.groupBy("depth", "fp").agg(F.sum(F.col("saved") + F.col("more_saved")).alias("saved_tokens"), F.sum(F.col("leaves") + F.col("more_leaves")).alias("n_leaves"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, ["depth", "fp"]).join(ends_of(rows), ["depth", "fp"], "left").join(above, ["depth", "parent"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
