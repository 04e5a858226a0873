"""Near-duplicate embeddings by NN-descent.

Every vector has a list of near neighbours. A round lets the neighbours of each vector
meet: neighbours of neighbours are compared, and better ones enter the lists. A list
that neighbours above the threshold fill is enlarged. Edges above the threshold tie
vectors into components. Then every vector has a second list, of its nearest vectors in
other components. What is above the threshold in it merges components and leaves the
list, so it never closes, however many near copies a vector has. Such rounds go on while
they merge anything. The exact step compares all vectors of a component, block against
block inside tasks. An audit compares a bounded sample with all vectors, and more rounds
follow while the vectors of any number of links miss too many of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, materialize
from .jaccard import _groups, _in_blocks

#: Neighbours in a list, and in one that is enlarged.
LIST, LIST_MAX = 8, 32
#: Orders by random hyperplanes and places looked at in each, for the first lists.
ORDERS, REACH = 3, 6
BLOCK = 512
#: Vectors of any kind, and of components of each size (by powers of two), that the
#: audit compares with all.
AUDIT, AUDIT_SIZE = 200, 40


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors; node names label, length and components. Null for what links with nothing."""
    for batch in batches:
        vectors, labels = batch.column(2), batch.column(1).to_pylist()
        part, node, unit = [], [], []
        offsets = vectors.offsets.to_numpy()
        values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
        valid = vectors.is_valid().to_pylist()
        for i, label in enumerate(labels):
            v = values[offsets[i] : offsets[i + 1]]
            if label is None or not valid[i] or not len(v) or not np.isfinite(v).all() or not v.any():
                part.append(None)
                node.append(None)
                unit.append(None)
                continue
            name = f"{label}:{len(v)}"
            w = v / np.abs(v).max()
            part.append(name)
            node.append(hashlib.blake2b(v.tobytes() + name.encode(), digest_size=16).digest())
            unit.append((w / np.sqrt(w @ w)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part, pa.string()), pa.array(node, pa.binary()), pa.array(unit, pa.binary())], names=["vec_id", "part", "node", "x"])


def _matrix(column) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)


def _codes(seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Signs of 30 random projections as a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for group in _runs_of_part(batches):
            x = _matrix(group.column("x"))
            d = x.shape[1]
            if d not in planes:
                planes[d] = np.random.default_rng([seed, d]).standard_normal((d, 30))
            code = ((x @ planes[d]) > 0) @ (1 << np.arange(30, dtype=np.int64))
            more = group.schema.names[3:]
            yield pa.RecordBatch.from_arrays([group.column("part"), pa.array(code), group.column("node"), group.column("x"), *[group.column(c) for c in more]], names=["part", "code", "node", "x", *more])

    return run


def _runs_of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch, cut where the part changes."""
    for batch in batches:
        parts = batch.column("part").to_pylist()
        cut = [0, *[i for i in range(1, len(parts)) if parts[i] != parts[i - 1]], len(parts)]
        for a, b in zip(cut, cut[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _look_around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates among the next REACH vectors in the order."""
    part, names, x = None, [], None
    for group in _runs_of_part(batches):
        own, ids, y = group.column("part")[0].as_py(), group.column("node").to_pylist(), _matrix(group.column("x"))
        if own == part:
            ids, y = names[-REACH:] + ids, np.concatenate([x[-REACH:], y])
            fresh = min(REACH, len(names))
        else:
            fresh = 0
        u, v, s = [], [], []
        for o in range(1, REACH + 1):
            if len(ids) <= o:
                break
            sim = (y[:-o] * y[o:]).sum(1)
            for i in range(max(0, fresh - o), len(ids) - o):
                u += [ids[i], ids[i + o]]
                v += [ids[i + o], ids[i]]
                s += [sim[i], sim[i]]
        part, names, x = own, ids, y
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(s, pa.float64())], names=["u", "v", "sim"])


def _look_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates in other components: for each vector, the last two vectors of each of
    the last REACH components before it in the order and, within a batch, behind it."""
    part, seen = None, {}
    for group in _runs_of_part(batches):
        own, ids, comps, x = group.column("part")[0].as_py(), group.column("node").to_pylist(), group.column("comp").to_pylist(), _matrix(group.column("x"))
        if own != part:
            part, seen = own, {}
        u, v, s = [], [], []
        for way, recent in ((range(len(ids)), seen), (range(len(ids) - 1, -1, -1), {})):
            for i in way:
                others = [e for c, held in recent.items() if c != comps[i] for e in held]
                if others:
                    u += [ids[i]] * len(others)
                    v += [name for name, _ in others]
                    s += (np.stack([y for _, y in others]) @ x[i]).tolist()
                held = recent.pop(comps[i], [])
                recent[comps[i]] = [*held[-1:], (ids[i], x[i])]
                if len(recent) > REACH:
                    del recent[next(iter(recent))]
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(s, pa.float64())], names=["u", "v", "sim"])


def _meet(threshold: float, across: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The local join: pairs of a vector's neighbours of which one is new. Each gets
    its best few of them that beat its list, and a few others above the threshold.
    Across: only pairs of two components, given in comp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: list[bytes] = []
        v: list[bytes] = []
        s: list[float] = []
        for group in _groups(batches, 1):
            if group.num_rows < 2:
                continue
            ids = group.column("c").to_pylist()
            new = np.array(group.column("new"))
            if not new.any():
                continue
            if across:
                codes: dict[bytes, int] = {}
                comp = np.array([codes.setdefault(c, len(codes)) for c in group.column("comp").to_pylist()])
                if len(codes) < 2:
                    continue
            x = _matrix(group.column("x"))
            bar = np.array(group.column("bar"), np.float64)
            sim = x @ x.T
            open_ = (new[:, None] | new[None]) & (sim > bar[:, None])
            np.fill_diagonal(open_, False)
            if across:
                open_ &= comp[:, None] != comp[None]
            score = np.where(open_, sim, -2.0)
            best = np.argsort(-score, 1)[:, :LIST]
            take = np.zeros_like(open_)
            np.put_along_axis(take, best, True, 1)
            above = open_ & (sim >= threshold)
            if above.sum(1).max() > LIST:
                other = np.argsort(np.where(above, np.random.default_rng(len(ids)).random(sim.shape), 2.0), 1)[:, :LIST]
                more = np.zeros_like(open_)
                np.put_along_axis(more, other, True, 1)
                take |= more & above
            i, j = np.nonzero(take & open_)
            u += [ids[k] for k in i]
            v += [ids[k] for k in j]
            s += sim[i, j].tolist()
            if len(u) > 20000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(s, pa.float64())], names=["u", "v", "sim"])
                u, v, s = [], [], []
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(s, pa.float64())], names=["u", "v", "sim"])

    return run


def _lists(edges: DataFrame, threshold: float) -> DataFrame:
    """(u, v, sim, new, bar): the LIST nearest of each u and, above the threshold, up
    to LIST_MAX others, chosen by a hash so that large groups stay connected. bar is
    what a newcomer must beat: with a full enlarged list nothing does."""
    edges = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    near = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    mixed = Window.partitionBy("u").orderBy((F.col("sim") < threshold).cast("int"), F.xxhash64("u", "v"))
    kept = edges.withColumn("_r", F.row_number().over(near)).withColumn("_h", F.row_number().over(mixed))
    kept = kept.where((F.col("_r") <= LIST) | ((F.col("sim") >= threshold) & (F.col("_h") <= LIST_MAX)))
    every = Window.partitionBy("u")
    above = F.count_if(F.col("sim") >= threshold).over(every)
    full = F.count(F.lit(1)).over(every) >= LIST
    last = F.min(F.when(F.col("_r") <= LIST, F.col("sim"))).over(every)
    bar = F.when(above >= LIST_MAX, F.lit(2.0)).when(above >= LIST, F.lit(threshold - 1e-9)).when(full, last).otherwise(F.lit(-2.0))
    return kept.select("u", "v", "sim", "new", bar.alias("bar"))


def _round(lists: DataFrame, vecs: DataFrame, threshold: float) -> DataFrame:
    both = lists.select(F.col("u").alias("p"), F.col("v").alias("c"), "new").unionByName(lists.select(F.col("v").alias("p"), F.col("u").alias("c"), "new"))
    both = both.groupBy("p", "c").agg(F.max("new").alias("new"))
    # A vector that very many have in their lists brings a sample of them together.
    degree = both.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * LIST).select(F.col("p").alias("_p"), "n")
    share = F.lit(4.0 * LIST) / F.col("n")
    both = both.join(degree, F.col("p") == F.col("_p"), "left")
    both = both.where(F.col("n").isNull() | (F.pmod(F.xxhash64("p", "c"), F.lit(1 << 20)) < share * (1 << 20)))
    bars = lists.select(F.col("u").alias("c"), "bar").distinct()
    met = both.select("p", "c", "new").join(bars, "c", "left").join(vecs.select(F.col("node").alias("c"), "x"), "c")
    met = met.select("p", "c", "new", F.coalesce("bar", F.lit(-2.0)).alias("bar"), "x")
    met = met.repartition("p").sortWithinPartitions("p", "c")
    found = met.mapInArrow(_meet(threshold), "u binary, v binary, sim double").withColumn("new", F.lit(True))
    return _lists(lists.select("u", "v", "sim", F.lit(False).alias("new")).unionByName(found), threshold)


def _some(pairs: DataFrame, seed: int) -> DataFrame:
    """(p, c), both ways, and of a vector that very many are paired with a sample of
    them, another one for each seed."""
    both = pairs.select(F.col("u").alias("p"), F.col("v").alias("c")).unionByName(pairs.select(F.col("v").alias("p"), F.col("u").alias("c"))).distinct()
    degree = both.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * LIST).select(F.col("p").alias("_p"), "n")
    share = F.lit(4.0 * LIST) / F.col("n")
    both = both.join(degree, F.col("p") == F.col("_p"), "left")
    return both.where(F.col("n").isNull() | (F.pmod(F.xxhash64(F.lit(seed), "p", "c"), F.lit(1 << 20)) < share * (1 << 20))).select("p", "c")


def _foreign(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (u, v, sim) of two components."""
    ends = [comps.select(F.col("node").alias(c), F.col("comp").alias(f"_{c}")) for c in ("u", "v")]
    pairs = pairs.join(ends[0], "u", "left").join(ends[1], "v", "left")
    return pairs.where(F.coalesce("_u", "u") != F.coalesce("_v", "v")).select("u", "v", "sim")


def _across(lists: DataFrame, foreign: DataFrame, vecs: DataFrame, comps: DataFrame, threshold: float, seed: int) -> DataFrame:
    """A round of the lists (u, v, sim) of the LIST nearest vectors in other components.
    What is above the threshold always enters."""
    named = vecs.join(comps, "node", "left").select("part", "node", "x", F.coalesce("comp", "node").alias("comp"))
    named = materialize(named, "vectors-in-components")
    order = named.mapInArrow(_codes(seed), "part string, code long, node binary, x binary, comp binary").repartitionByRange("part", "code").sortWithinPartitions("part", "code", "node")
    found = order.mapInArrow(_look_across, "u binary, v binary, sim double")
    full = F.min("sim").alias("last"), F.count(F.lit(1)).alias("n")
    bars = foreign.groupBy(F.col("u").alias("c")).agg(*full).select("c", F.when(F.col("n") >= LIST, F.least("last", F.lit(threshold - 1e-9))).alias("bar"))
    # Neighbours of either kind meet; the own component's don't crowd out the others.
    # The nearest in other components are never sampled, only those that name a vector as such.
    met = _some(lists, seed).unionByName(_some(foreign, seed)).unionByName(foreign.select(F.col("u").alias("p"), F.col("v").alias("c"))).distinct()
    met = met.join(bars, "c", "left").join(named.select(F.col("node").alias("c"), "x", "comp"), "c")
    met = met.select("p", "c", F.lit(True).alias("new"), F.coalesce("bar", F.lit(-2.0)).alias("bar"), "x", "comp")
    met = met.repartition("p").sortWithinPartitions("p", "c")
    found = found.unionByName(met.mapInArrow(_meet(threshold, True), "u binary, v binary, sim double")).unionByName(foreign)
    found = found.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    near = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return found.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= LIST).drop("_r")


def _count(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            x = _matrix(group.column("x"))
            own, copies = np.array(group.column("block")), np.array(group.column("copies"), np.int64)
            linked = (x @ x.T) >= threshold
            np.fill_diagonal(linked, False)
            if group.column("b1")[0].as_py() != group.column("b2")[0].as_py():
                linked &= own[:, None] != own[None]
            yield pa.RecordBatch.from_arrays([group.column("node").combine_chunks(), pa.array(linked.astype(np.int64) @ copies)], names=["node", "links"])

    return run


def audit_recall(vecs: DataFrame, comps: DataFrame, threshold: float, sample: int = AUDIT) -> float:
    """The mean share of a vector's links that lie inside its component, over a bounded
    sample of vectors with links: `sample` of all and AUDIT_SIZE of the components of each
    size, against all vectors. Vectors are grouped by their number of links (by powers of
    two) and the least mean counts, so that large groups don't hide what others miss."""
    sizes = comps.groupBy("comp").agg(F.floor(F.log2(F.count(F.lit(1)))).alias("kind"))
    named = vecs.join(comps.select("node", "comp"), "node", "left").join(sizes, "comp", "left")
    h = F.xxhash64("node")
    each = Window.partitionBy("kind").orderBy(h, "node")
    drawn = named.where("kind is not null").withColumn("_r", F.row_number().over(each)).where(F.col("_r") <= AUDIT_SIZE).drop("_r")
    some = {r["node"]: r for r in named.orderBy(h, "node").limit(sample).collect() + drawn.select(named.columns).collect()}
    if not some:
        return 1.0
    shared = vecs.sparkSession.sparkContext.broadcast([(r["part"], r["node"], r["comp"], np.frombuffer(r["x"], np.float64)) for r in some.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs_of_part(batches):
            own = [q for q in shared.value if q[0] == group.column("part")[0].as_py()]
            if own:
                i, j = np.nonzero(_matrix(group.column("x")) @ np.stack([q[3] for q in own]).T >= threshold)
                node, comp = group.column("node").to_pylist(), group.column("comp").to_pylist()
                n, good = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
                for a, b in zip(i.tolist(), j.tolist()):
                    if node[a] != own[b][1]:
                        n[b] += 1
                        good[b] += comp[a] is not None and comp[a] == own[b][2]
                yield pa.RecordBatch.from_arrays([pa.array([q[1] for q in own], pa.binary()), pa.array(n), pa.array(good)], names=["node", "n", "good"])

    counts = named.select("part", "node", "comp", "x").mapInArrow(run, "node binary, n long, good long").groupBy("node").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).where("n > 0")
    means = counts.groupBy(F.floor(F.log2("n")).alias("links")).agg(F.avg(F.col("good") / F.col("n")).alias("share"))
    least = means.agg(F.min("share")).first()[0]
    return 1.0 if least is None else least


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, rounds: int = 2, max_rounds: int = 8, recall: float = 0.999, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors. `rounds` of the
    lists are made, and across components until two merge nothing and the audit finds
    `recall`; an audit that finds less after max_rounds (2 at least) that merge nothing is an error.

    Vectors with equal labels (and lengths) whose cosine in double precision is at
    least threshold are linked. n_links counts the other vectors linked directly,
    component_id is the least vec_id that links reach, kept marks it. Null labels and
    vectors that are null, empty, zero or hold null or non-finite components link with
    nothing. Equal vectors are one in the search and count as many. Null and repeated
    ids are carried through; a null id is a component_id only where there is no other.
    An empty table gives no rows. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = materialize(rows.mapInArrow(_prepare, "vec_id long, part string, node binary, x binary"), "vectors")
    alone = rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("part").alias("part"), F.first("x").alias("x"))
    alone = materialize(alone, "distinct")
    vecs = alone.select("part", "node", "x")
    edges = None
    for k in range(ORDERS):
        order = vecs.mapInArrow(_codes(k), "part string, code long, node binary, x binary").repartitionByRange("part", "code").sortWithinPartitions("part", "code", "node")
        found = order.mapInArrow(_look_around, "u binary, v binary, sim double")
        edges = found if edges is None else edges.unionByName(found)
    lists = materialize(_lists(edges.withColumn("new", F.lit(True)), threshold), "neighbours")
    for _ in range(rounds):
        lists = materialize(_round(lists, vecs, threshold), "neighbours")
    comps = connected_components(lists.where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b")))
    comps = materialize(comps, "components")
    foreign = materialize(_foreign(lists.select("u", "v", "sim"), comps), "foreign")
    # Rounds that merge components don't count, as there are fewer components after each.
    quiet, k = 0, ORDERS
    while quiet < max(2, max_rounds):
        foreign = materialize(_across(lists, foreign, vecs, comps, threshold, k), "foreign")
        k += 1
        bridges = foreign.where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))
        if not bridges.isEmpty():
            known = comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))
            comps = materialize(connected_components(known.unionByName(bridges)), "components")
            foreign = materialize(_foreign(foreign, comps), "foreign")
            continue
        quiet += 1
        if quiet >= 2 and (reached := audit_recall(vecs, comps, threshold)) >= recall:
            break
    else:
        raise RuntimeError(f"{reached:.4f} of the links of a sample found after {max_rounds} rounds without a merge, {recall} wanted")
    inside = materialize(comps.join(alone, "node"), "linked")
    per = materialize(inside.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.min("least").alias("component_id")), "component-sizes")
    dealt = inside.join(per, "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = _in_blocks(dealt, "comp", "block", "blocks").select("comp", "b1", "b2", "block", "node", "copies", "x")
    counts = dealt.repartition("comp", "b1", "b2").sortWithinPartitions("comp", "b1", "b2", "node").mapInArrow(_count(threshold), "node binary, links long")
    counts = counts.groupBy("node").agg(F.sum("links").alias("links"))
    named = alone.select("node", "copies", "least").join(inside.select("node", "comp").join(per.select("comp", "component_id"), "comp"), "node", "left").join(counts, "node", "left")
    links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    named = materialize(named.select("node", links.alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "vector-results")
    out = rows.select("vec_id", "node").join(named, "node", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
