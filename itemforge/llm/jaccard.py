"""N-gram Jaccard join by chosen paths.

Texts are sets of word n-grams. Each run deals sets into buckets: a set goes into a
bucket for each of its few tokens that a hash shared by all sets chooses, so two sets
meet in a run with a chance that rises with what they share. Buckets that are too large
are split again by further tokens, which a hash of each bucket's own chooses, so paths of
one run don't fail together; small ones are compared by brute force. As many runs are made
as the target recall needs.

In a bucket, sketches tell which sets may be similar; the links found tie sets into
components. The exact step then lays whole sets of a component side by side, block
against block, and counts every link once, inside tasks: pairs are never rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, filter_size, free_name, hash_filter, materialize, worker_store

#: Tokens that a run chooses from a set, on average, at each level of a path.
CHOSEN = 3
LEVELS = 3
#: Larger buckets are split; at the last level, cut in blocks of so many sketches.
BUCKET = 4096
#: Sets and tokens of a block of the exact step, about: one task holds two blocks.
BLOCK_SETS, BLOCK_TOKENS = 256, 1 << 20
SKETCH = 32
#: What of the chance to miss a pair is left to sketches; the rest is for the runs.
SKETCH_SHARE = 0.1
_DEEPER = 0xA0761D6478BD642F
_ODD = re.compile(r"(?:(?![\x00-\x7f])\W)+")
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True


def runs_for(recall: float, similarity: float, levels: int = LEVELS) -> int:
    """Runs after which two sets of this similarity have met with this chance, even
    if their buckets are split at every level and one set holds the other. Each bucket
    chooses anew, so a run misses if all its shared tokens lead to buckets that miss."""
    missed = 0.0
    for _ in range(levels):
        missed = math.exp(-CHOSEN * similarity * (1 - missed))
    return max(1, math.ceil(math.log(1 - recall) / math.log(missed)))


def sketch_cut(recall: float, similarity: float) -> int:
    """Equal places from which two sketches may be of sets so similar: the most that sets of this
    similarity reach but for a chance of (1 - recall) * SKETCH_SHARE. All runs share the sketches."""
    below, k = 0.0, 0
    while k < SKETCH:
        below += math.comb(SKETCH, k) * similarity**k * (1 - similarity) ** (SKETCH - k)
        if below > (1 - recall) * SKETCH_SHARE:
            break
        k += 1
    return k


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the n-grams of each text, one text after the other,
    and where each begins. Fewer than n words are one gram; no word, no gram."""
    lowered = [(t or "").lower() for t in texts]
    data = [(t if t.isascii() else _ODD.sub(" ", t)).encode("utf-8", "replace") for t in lowered]
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    word = _WORD_BYTE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    doc_end = np.cumsum([len(d) + 1 for d in data])
    words_in = np.diff(np.concatenate([[0], np.searchsorted(first, doc_end)]))
    if len(first):
        # A polynomial hash of each word's bytes: differences of running sums, scaled to the word's start.
        size = last - first
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
        letters = (raw[np.repeat(first, size) + at].astype(np.uint64) + np.uint64(1)) * power[at]
        h = _mix(np.add.reduceat(letters, np.cumsum(size) - size))
    else:
        h = np.zeros(0, np.uint64)
    out, start = [], 0
    for count in words_in.tolist():
        w = h[start : start + count]
        start += count
        if count == 0:
            out.append(w)
            continue
        k = min(n, count)
        g = np.zeros(count - k + 1, np.uint64)
        for j in range(k):
            g = g * np.uint64(0xD6E8FEB86659FD93) + w[j : count - k + 1 + j]
        out.append(np.unique(_mix(g + np.uint64(k))))
    sizes = np.array([len(x) for x in out], np.int64)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def _reduce(values: np.ndarray, starts: np.ndarray, how: np.ufunc) -> np.ndarray:
    return how.reduceat(values, starts) if len(starts) else values[:0]


def names(sets: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """128 bits for each (non-empty) set."""
    sums = [_reduce(x, starts, np.add) for x in (sets, _mix(sets ^ np.uint64(0x5851F42D4C957F2D)))]
    return [x.tobytes() for x in np.stack(sums, 1)]


def _pieces(batch: pa.RecordBatch, column: int, rows: int = 200, letters: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of few rows and, but for a longer text, few letters."""
    sizes = [len(t) if t else 0 for t in batch.column(column).to_pylist()]
    at = held = 0
    for i, size in enumerate(sizes):
        if i > at and (i - at >= rows or held + size > letters):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if at < len(sizes):
        yield batch.slice(at)


def sketch_partition(n: int, runs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per row: a 128-bit name of its set, the set's size, sketch and chosen tokens
    of the first level (a list a run). The name is null where there are no words."""
    lists = runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("")  # a worker that encoded tokens before needs its memos no more
        for batch in batches:
            for part in _pieces(batch, 1):
                sets, offsets = shingle_sets(part.column(1).to_pylist(), n)
                all_sizes = np.diff(offsets)
                full = np.flatnonzero(all_sizes)
                starts, size = offsets[:-1][full], all_sizes[full]
                owner = np.repeat(full, size)
                with np.errstate(over="ignore"):
                    sketch = np.zeros((part.num_rows, SKETCH), "<u2")
                    for k in range(SKETCH):
                        sketch[full, k] = _reduce(_mix(sets + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))), starts, np.minimum) & np.uint64(0xFFFF)
                    bar = np.repeat((np.minimum(1.0, CHOSEN / size) * (2.0**64 - 2049)).astype(np.uint64), size)
                    which, token = [], []
                    for k in range(lists):
                        r = _mix(sets ^ np.uint64((k + 1) * 0xD1342543DE82EF95 % (1 << 64)))
                        pick = np.flatnonzero(r <= bar)
                        which.append(owner[pick] * lists + k)
                        token.append(r[pick].view(np.int64))
                    name = names(sets, starts)
                slot, token = np.concatenate(which), np.concatenate(token)
                inner = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=part.num_rows * lists))]).astype(np.int32)
                chosen = pa.ListArray.from_arrays(pa.array(inner), pa.array(token[np.argsort(slot, kind="stable")]))
                chosen = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * lists), chosen)
                node: list = [None] * part.num_rows
                for i, x in zip(full.tolist(), name):
                    node[i] = x
                columns = [part.column(0), pa.array(node, pa.binary()), pa.array(all_sizes), pa.array([x.tobytes() for x in sketch], pa.binary()), chosen, part.column(2), part.column(3)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "size", "sketch", "chosen", "row", "th"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows that agree in the first `keys` columns, of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_pylist() for c in range(keys)]
        marks = list(zip(*columns))
        cut = [0] + [i for i in range(1, len(marks)) if marks[i] != marks[i - 1]] + [len(marks)]
        for a, b in zip(cut, cut[1:]):
            if last is not None and marks[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = marks[a]
    if held:
        yield pa.Table.from_batches(held)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def tie(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j

    def stars(self, names: list[bytes]) -> list[tuple[bytes, bytes]]:
        """What is tied, each name with the least one that it is tied with."""
        roots = [self.find(i) for i in range(len(names))]
        least: dict[int, bytes] = {}
        for r, x in zip(roots, names):
            least[r] = min(x, least.get(r, x))
        return [(x, least[r]) for r, x in zip(roots, names) if x != least[r]]


def bucket_links(similarity: float, cut: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Brute force in each bucket (or two blocks of a large one) by sketches; yields
    stars of what links tie, fewer rows than the bucket has sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[bytes] = []
        b: list[bytes] = []
        for group in _groups(batches, 3):
            if group.num_rows < 2:
                continue
            node = group.column("node").to_pylist()
            size = np.array(group.column("size"), np.float64)
            sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), "<u2").reshape(len(node), SKETCH)
            ties = _Union(len(node))
            for i in range(len(node) - 1):
                alike = (sketch[i + 1 :] == sketch[i]).sum(1) >= cut
                alike &= np.minimum(size[i], size[i + 1 :]) >= similarity * np.maximum(size[i], size[i + 1 :]) - 1e-9
                for j in (np.flatnonzero(alike) + i + 1).tolist():
                    ties.tie(i, j)
            for x, y in ties.stars(node):
                a.append(x)
                b.append(y)
            if len(a) > 10000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def _in_blocks(rows: DataFrame, key: str, block: str, blocks: str) -> DataFrame:
    """Each row once for each pair of blocks that its own is part of: (key, b1, b2)."""
    other = F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    rows = rows.withColumn("_o", other)
    return rows.withColumn("b1", F.least(block, "_o")).withColumn("b2", F.greatest(block, "_o")).drop("_o")


def choose_deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, bucket) of the next level, for rows (node, tokens, buckets): the tokens of
    the set that each bucket's own hash chooses."""
    for batch in batches:
        node, child = [], []
        for x, data, buckets in zip(*[batch.column(c).to_pylist() for c in range(3)]):
            tokens = np.frombuffer(data, np.uint64)
            bar = np.uint64(min(1.0, CHOSEN / len(tokens)) * (2.0**64 - 2049))
            with np.errstate(over="ignore"):
                for salt in _mix(np.array(buckets, np.int64).view(np.uint64) + np.uint64(_DEEPER)):
                    r = _mix(tokens ^ salt)
                    r = _mix(r[r <= bar] + salt)
                    node += [x] * len(r)
                    child.append(r.view(np.int64))
            if len(node) > 100000:
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(np.concatenate(child))], names=["node", "bucket"])
                node, child = [], []
        if node:
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(np.concatenate(child))], names=["node", "bucket"])


def _bucket_rows(sets: DataFrame, levels: int, whole: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(bucket, b1, b2, node, size, sketch): the buckets to compare. whole gives the
    (node, tokens) of given nodes; it is asked for those in buckets that are split."""
    level = sets.select("node", F.posexplode("chosen").alias("run", "t")).select("node", "run", F.explode("t").alias("t"))
    level = level.select("node", F.xxhash64("run", "t").alias("bucket"))
    done = tokens = None
    for k in range(1, levels + 1):
        level = materialize(level, f"paths{k}")
        count = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        count = materialize(count, f"buckets{k}")
        final = k == levels
        wanted = count if final else count.where(F.col("n") <= BUCKET)
        shared = hash_filter(count.select("bucket"), filter_size(count.count()))
        level = level.where(shared(F.col("bucket")))  # most tokens are in one set only
        ready = level.join(wanted.hint("merge"), "bucket")
        ready = ready.select("bucket", "node", F.ceil(F.col("n") / BUCKET).cast("int").alias("blocks"))
        done = ready if done is None else done.unionByName(ready)
        if final:
            break
        large = count.where(F.col("n") > BUCKET).select("bucket")
        if large.isEmpty():
            break
        deeper = level.join(large, "bucket").groupBy("node").agg(F.collect_set("bucket").alias("buckets"))
        deeper = materialize(deeper, f"split{k}")
        if tokens is None:
            tokens = materialize(whole(deeper.select("node")), "split-sets")
        level = deeper.join(tokens.hint("merge"), "node").select("node", "tokens", "buckets").mapInArrow(choose_deeper, "node binary, bucket long")
    done = done.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    return _in_blocks(done.join(sets.select("node", "size", "sketch").hint("merge"), "node"), "bucket", "block", "blocks").select("bucket", "b1", "b2", "node", "size", "sketch")


def exact_links(n: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All similarities of a pair of blocks, from whole sets. Yields per set how many
    documents it links to there (each link's weight is the other set's copies), and
    stars of what the links tie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            first = {x: i for i, x in reversed([*enumerate(group.column("node").to_pylist())])}
            group = group.take(sorted(first.values()))  # a repeated row stands for one set
            node = group.column("node").to_pylist()
            b1, b2 = group.column("b1")[0].as_py(), group.column("b2")[0].as_py()
            own = np.array(group.column("block"))
            copies = np.array(group.column("copies"), np.int64)
            sets = [np.frombuffer(x, np.uint64) for x in group.column("tokens").to_pylist()]
            size = np.array([len(x) for x in sets])
            order = np.argsort(size, kind="stable")
            node, sets, size, own, copies = [node[i] for i in order], [sets[i] for i in order], size[order], own[order], copies[order]
            values = np.concatenate(sets)
            distinct, code = np.unique(values, return_inverse=True)
            starts = np.cumsum(size) - size
            mark = np.zeros(len(distinct), np.int32)
            links = np.zeros(len(node), np.int64)
            ties = _Union(len(node))
            for i in range(len(node) - 1):
                stop = int(np.searchsorted(size, size[i] / similarity + 1e-9, side="right"))
                if stop <= i + 1:
                    continue
                mine = code[starts[i] : starts[i] + size[i]]
                mark[mine] = 1
                lo, hi = starts[i + 1], starts[stop - 1] + size[stop - 1]
                shared = np.add.reduceat(mark[code[lo:hi]], starts[i + 1 : stop] - lo)
                mark[mine] = 0
                # shared / union >= similarity, in whole numbers as far as they go
                alike = shared >= similarity * (size[i] + size[i + 1 : stop] - shared) - 1e-9
                if b1 != b2:
                    alike &= own[i + 1 : stop] != own[i]
                found = np.flatnonzero(alike) + i + 1
                links[i] += copies[found].sum()
                links[found] += copies[i]
                for j in found.tolist():
                    ties.tie(i, j)
            forest = ties.stars(node)
            rows = np.flatnonzero(links).tolist()
            a = [node[i] for i in rows] + [x for x, _ in forest]
            b = [None] * len(rows) + [y for _, y in forest]
            c = [int(links[i]) for i in rows] + [0] * len(forest)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.int64())], names=["a", "b", "links"])

    return run


def _set_partition(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, 1):
                sets, offsets = shingle_sets(part.column(1).to_pylist(), n)
                ours = part.column(0).to_pylist()
                tokens = [sets[a:b].tobytes() if b > a and names(sets[a:b], np.zeros(1, np.int64))[0] == x else None for a, b, x in zip(offsets, offsets[1:], ours)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, pa.binary()), *[part.column(c) for c in range(2, part.num_columns)]], names=["node", "tokens", *part.schema.names[2:]])

    return run


def _whole_sets(rows: DataFrame, wanted: DataFrame, n: int, more: str = "") -> DataFrame:
    """(node, tokens and the columns more) of the nodes of wanted (node, least, th, more), from the
    texts with the id and hash of their least documents, so that rows which share an id, or
    have none, meet their own sets only. Texts of other sets stay where they are."""
    kept = [c.split()[0] for c in more.split(",") if c]
    ours = hash_filter(wanted.select(F.xxhash64("least", "th").alias("h")), filter_size(wanted.count()))
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("_th"))
    texts = keyed.where(ours(F.xxhash64("doc_id", "_th"))).join(wanted.hint("merge"), (F.col("_th") == F.col("th")) & F.col("doc_id").eqNullSafe(F.col("least")))
    schema = "node binary, tokens binary" + (f", {more}" if more else "")
    return texts.select("node", "text", *kept).mapInArrow(_set_partition(n), schema).where("tokens is not null")


def similar_documents(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, n_copies, kept), one row per row of docs.

    Two documents are linked if the sets of their word n-grams have a Jaccard
    similarity of at least `similarity`. n_links counts the other documents that
    one is linked with directly, n_copies those with an equal set. class_id is the
    least doc_id that links reach; kept marks one row of each class, with this id. Pairs are missed with a chance of
    at most 1 - recall; what is found is exact.

    Texts of fewer than n words have one gram, all their words. Texts without words
    (null, empty) link with nothing and are classes of their own. A null id is
    never a class_id unless its class has no other. Rows that repeat an id
    are documents of their own. An empty table gives no rows; other columns are ignored.
    """
    # The keys are written with the sketches, once, and not computed again: texts are found by id and hash.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return _classes(rows, n, similarity, recall).drop("row")


def _classes(rows: DataFrame, n: int, similarity: float, recall: float) -> DataFrame:
    """similar_documents() of rows (doc_id, text, row), with the row's key."""
    runs = runs_for(1 - (1 - recall) * (1 - SKETCH_SHARE), similarity)
    hashed = rows.select("doc_id", "text", "row", F.xxhash64("text").alias("th"))
    sketched = hashed.mapInArrow(sketch_partition(n, runs), "doc_id long, node binary, size long, sketch binary, chosen array<array<long>>, row long, th long")
    sketched = materialize(sketched, "sketches")
    members = sketched.select("doc_id", "node", "row", "th")
    # The first row has the least id, null only if there is no other, and the least key.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row", "th")).alias("first")
    alone = members.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), first)
    alone = alone.select("node", "copies", F.col("first.doc_id").alias("least"), F.col("first.th").alias("th"), "first")
    alone = materialize(alone, "set-counts")
    # Equal sets have equal sketches and tokens, so one row of them stands for all. Only
    # what may have copies goes through the join that finds it.
    copied = alone.where("copies > 1").select(F.xxhash64("node").alias("h"))
    may_be_copied = hash_filter(copied, filter_size(copied.count()))
    known = sketched.where("node is not null")
    maybe = known.where(may_be_copied(F.xxhash64("node"))).join(alone.select(F.col("node").alias("_n"), F.col("first.row").alias("_row")).hint("merge"), F.col("node") == F.col("_n"))
    maybe = maybe.where("row = _row").drop("_n", "_row")
    sets = known.where(~may_be_copied(F.xxhash64("node"))).unionByName(maybe).drop("doc_id", "row", "th")
    sets = materialize(sets, "sets")
    dealt = _bucket_rows(sets, LEVELS, lambda nodes: _whole_sets(rows, nodes.join(alone, "node").select("node", "least", "th"), n).dropDuplicates(["node"]))
    dealt = dealt.repartition("bucket", "b1", "b2").sortWithinPartitions("bucket", "b1", "b2", "node")
    links = materialize(dealt.mapInArrow(bucket_links(similarity, sketch_cut(recall, similarity)), "a binary, b binary"), "bucket-links")
    counted = _count_links(rows, links, alone, sets.select("node", "size"), n, similarity)
    forest = counted.where("b is not null").select("a", "b")
    groups = connected_components(forest)
    totals = counted.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = alone.join(groups, "node", "left").select("node", "copies", "first", F.coalesce("comp", "node").alias("comp"))
    named = materialize(named.join(totals, "node", "left").select("node", "copies", "first", "comp", F.coalesce("links", F.lit(0)).alias("links")), "set-classes")
    least = materialize(named.where("links > 0").groupBy("comp").agg(F.min("first").alias("class_first")), "class-ids")
    named = named.join(least, "comp", "left").select("node", (F.col("links") + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("n_copies"), F.coalesce("class_first", "first").alias("first"))
    named = materialize(named.select("node", "n_links", "n_copies", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("class_row")), "set-results")
    zero = F.lit(0).cast("long")
    out = members.join(named.hint("merge"), "node", "left")
    class_id = F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    kept = F.col("row") == F.coalesce("class_row", "row")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_copies", zero).alias("n_copies"), kept.alias("kept"), "row")


def _count_links(rows: DataFrame, links: DataFrame, alone: DataFrame, sizes: DataFrame, n: int, similarity: float) -> DataFrame:
    """exact_links() over the components that the links of the buckets make. Texts of
    sets in no component stay where they are; whole sets are shuffled once."""
    comp = connected_components(links).join(alone, "node").join(sizes, "node")
    comp = materialize(comp, "candidates")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("size") / BLOCK_TOKENS)).cast("int")
    per = materialize(comp.groupBy("comp").agg(blocks.alias("blocks")), "components")
    comp = comp.join(per, "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    comp = materialize(comp.select("node", "comp", "least", "th", "copies", "block", "blocks"), "candidate-blocks")
    sets = _whole_sets(rows, comp, n, "comp binary, copies long, block int, blocks int")
    dealt = _in_blocks(sets, "comp", "block", "blocks").select("comp", "b1", "b2", "block", "node", "copies", "tokens")
    dealt = dealt.repartition("comp", "b1", "b2").sortWithinPartitions("comp", "b1", "b2", "node")
    return materialize(dealt.mapInArrow(exact_links(n, similarity), "a binary, b binary, links long"), "links")


def drop_similar(docs: DataFrame, n: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are the first of their class, unchanged, whatever columns there
    are. Rows that share an id, or have none, are told apart by a key that is written with
    them; of a class the row with the least id stays (null only if there is no other), of
    equal ids the first. Texts without words, null and empty ones, stay. An empty table
    gives no rows."""
    key = free_name(docs, "_row")
    keyed = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    rows = keyed.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(key).alias("row"))
    gone = _classes(rows, n, similarity, 0.9999).where("not kept").select(F.col("row").alias(key))
    return keyed.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
