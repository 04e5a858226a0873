"""Ranked lexical search over a tiered index.

The index holds, for each term of the queries, the documents it stands in and its impact there. A
term's postings of highest impact are its first tier; what the tier leaves out is bounded by the
term's largest impact outside it, the residual. A query is answered by a tier if its
residuals together can't lift an unseen document to the tenth place; whatever a tier
can't prove falls through to the next, and the last is the whole index, read document by
document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import filter_size, hash_filter, materialize, new_path
from .toxicity import slices

#: Postings of a term in the tiers above the whole index, at most.
TIERS = (500, 4_000)
#: Impacts of a term are told apart in so many steps where tiers are cut.
STEPS = 1_000
SCALE = 1_000_000_000
#: Terms of the queries that are compared with all documents at once, about, and scores held at once.
BLOCK_TERMS, CELLS = 100_000, 1 << 21
#: Slots of the table that tells early which postings no tier wants.
SLOTS = 1 << 16

_LOW = np.zeros(256, np.uint8)
for _a, _b, _move in ((48, 58, 0), (65, 91, 32), (97, 123, 0), (128, 256, 0)):
    _LOW[_a:_b] = np.arange(_a, _b) + _move


def terms_of(texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of all texts in order, and the text of each: what ASCII characters other than
    letters and digits part; only A-Z are lower-cased."""
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    low = _LOW[np.frombuffer(b"\n".join(data) + b"\n", np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], low != 0, [False]]).view(np.int8)))
    first, last = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(low[low != 0])])
    ends = np.cumsum([len(d) + 1 for d in data])
    return words.dictionary_encode(), np.searchsorted(ends, first, side="right")


def _hashes(words: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    if not len(words):
        return np.zeros(0, np.uint64)
    size = np.diff(offsets)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    at = np.arange(len(raw)) - np.repeat(offsets[:-1] - offsets[0], size)
    power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
    h = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * power[at], offsets[:-1] - offsets[0])  # terms are never empty
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def forward(rows: DataFrame, may_be_asked: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """rows (id, text, row) as (id, row, n, terms, tfs): how many terms the text has, and its
    different terms, those that may be asked for, with how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1).fill_null("")):
                k = len(texts)
                words, text = terms_of(texts.to_pylist())
                index = words.indices.to_numpy()
                n = np.bincount(text, minlength=k)
                asked = np.ones(len(words.dictionary), bool) if may_be_asked is None else may_be_asked(_hashes(words.dictionary))
                keep = asked[index]
                width = max(1, len(words.dictionary))
                pairs, tf = np.unique(text[keep] * width + index[keep], return_counts=True)
                ends = np.concatenate([[0], np.cumsum(np.bincount(pairs // width, minlength=k))]).astype(np.int32)
                found = words.dictionary.take(pa.array(pairs % width)).cast(pa.string())
                columns = [batch.column(0).slice(at, k), batch.column(2).slice(at, k), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), found), pa.ListArray.from_arrays(pa.array(ends), pa.array(tf))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "n", "terms", "tfs"])

    return rows.mapInArrow(run, "id long, row long, n long, terms array<string>, tfs array<long>")


def term_filter(terms: DataFrame, bits: int) -> Callable[[np.ndarray], np.ndarray]:
    """A test in tasks whether hashes of terms may be among terms (one string column). bits,
    a power of two of at most 2^25, is its size: 4 MB, however many terms there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _hashes(batch.column(0).cast(pa.binary())) & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(5)).astype(np.int64)), pa.array(np.left_shift(np.int64(1), (h & np.uint64(31)).astype(np.int64)))], names=["w", "v"])

    got = terms.mapInArrow(run, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).collect()  # bits / 32 rows at most
    table = np.zeros(bits // 32, np.uint32)
    for r in got:
        table[r["w"]] = r["v"]
    shared = terms.sparkSession.sparkContext.broadcast(table)

    def test(h: np.ndarray) -> np.ndarray:
        h = h & np.uint64(bits - 1)
        return (shared.value[(h >> np.uint64(5)).astype(np.int64)] >> (h & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0

    return test


def postings_of(index: DataFrame, docs: int, terms: int) -> DataFrame:
    """(term, id, row, impact): what a term adds to a document's score for each unit of its weight."""
    m = F.expr(f"10L + (cast(n as decimal(19,0)) * {90 * docs}BD) div {terms}")
    rows = index.where(F.size("terms") > 0).select("id", "row", m.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    return rows.select(F.col("x.terms").alias("term"), "id", "row", F.expr(f"({SCALE}L * x.tfs) div (1000L * x.tfs + 8L * m)").alias("impact"))


def cut_tiers(postings: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(term, df, least1, rest1, least2, ...): tier k of a term holds its postings with an impact of at
    least `least`k, at most sizes[k - 1] of them; `rest`k is the largest impact outside it, 0 if there
    is none. From counts per step of impact, at most STEPS rows for a term."""
    step = (F.col("impact") / (SCALE // 1000 // STEPS)).cast("int")
    steps = postings.groupBy("term", step.alias("step")).agg(F.count(F.lit(1)).alias("c"), F.max("impact").alias("most"), F.min("impact").alias("least"))
    upto = F.sum("c").over(Window.partitionBy("term").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0))
    steps = steps.withColumn("upto", upto)
    cuts = []
    for k, size in enumerate(sizes, 1):
        inside = F.col("upto") <= size
        cuts += [F.coalesce(F.min(F.when(inside, F.col("least"))), F.lit(SCALE)).alias(f"least{k}"), F.coalesce(F.max(F.when(~inside, F.col("most"))), F.lit(0)).alias(f"rest{k}")]
    return steps.groupBy("term").agg(F.sum("c").alias("df"), *cuts)


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The k rows of each item with the highest scores, equal ones by id (null first) and row."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_first(), "row")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def answer(asked: DataFrame, postings: DataFrame, index: DataFrame, rest: str, k: int, docs: int, terms: int) -> DataFrame:
    """(item, id, row, score) of the k best documents, for those items of asked (item, term,
    weight, rest*) that the postings of a tier answer with proof; no row for the others.

    low, what a document gets from the tier, is a bound from below, and the k-th best of them
    the bar. Documents outside the tier get at most all residuals, which must be under the bar; those
    inside get at most the residuals of the terms they weren't found by, and where that
    reaches the bar, their score is made from the whole index."""
    limits = asked.groupBy("item").agg(F.sum(F.col("weight") * F.col(rest)).alias("limit"))
    hits = postings.join(asked.select("item", "term", "weight", F.col(rest).alias("rest")), "term")
    low = hits.groupBy("item", "row").agg(F.min("id").alias("id"), F.sum(F.col("weight") * F.col("impact")).alias("low"), F.sum(F.col("weight") * F.col("rest")).alias("seen"))
    low = materialize(low, "partial-scores")
    bar = _best(low.select("item", "id", "row", F.col("low").alias("score")), k).groupBy("item").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("bar"))
    bar = limits.join(bar, "item", "left").select("item", "limit", F.when(F.col("found") == k, F.col("bar")).otherwise(0).alias("bar"))
    # With no residual at all the tier holds every posting of the item.
    proven = materialize(bar.where("limit = 0 or limit < bar"), "proven")
    ours = low.join(proven, "item")
    done = ours.where("limit = 0").select("item", "id", "row", F.col("low").alias("score"))
    open_ = materialize(ours.where("limit > 0 and low + limit - seen >= bar").select("item", "row"), "candidates")
    wanted = hash_filter(open_.select(F.xxhash64("row")), filter_size(open_.count()))
    near = index.where(wanted(F.xxhash64("row"))).join(open_.select("row").distinct(), "row", "left_semi")
    full = postings_of(near, docs, terms).join(open_, "row").join(asked.select("item", "term", "weight"), ["item", "term"])
    full = full.groupBy("item", "row").agg(F.min("id").alias("id"), F.sum(F.col("weight") * F.col("impact")).alias("score"))
    best = _best(done.unionByName(full.select("item", "id", "row", "score")).where("score > 0"), k).drop("rank")
    # An item that is answered with no document has a row of its own.
    return proven.select("item").join(best, "item", "left")


def whole_index(block: pa.Table, k: int, docs: int, terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores of all documents of a task for a block of items (item, term, weight), document by
    document; yields the k best of each item."""
    items, item = np.unique(block.column("item").to_numpy(), return_inverse=True)
    vocabulary = pc.unique(block.column("term").combine_chunks())
    term = pc.index_in(block.column("term").combine_chunks(), vocabulary).to_numpy()
    order = np.argsort(term, kind="stable")
    uses = np.bincount(term, minlength=len(vocabulary))
    first, item, weight = np.cumsum(uses) - uses, item[order], block.column("weight").to_numpy()[order].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.iinfo(np.int64).min
        best = np.zeros((len(items), 0, 3), np.int64)  # score, id and row; null ids are the least integer
        step = max(1, CELLS // len(items))
        for batch in batches:
            ids = pc.fill_null(batch.column(0), least).to_numpy()
            by_id = np.lexsort((batch.column(1).to_numpy(), ids))
            batch, ids = batch.take(pa.array(by_id)), ids[by_id]
            row, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            m = 10 + np.array([90 * docs * int(x) // terms for x in n], np.int64)
            ends = batch.column(3).offsets.to_numpy()
            code = pc.index_in(batch.column(3).flatten(), vocabulary)
            tf = batch.column(4).flatten().to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            known = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
            code, tf, doc = pc.fill_null(code, 0).to_numpy()[known], tf[known], doc[known]
            impact = SCALE * tf // (1000 * tf + 8 * m[doc])
            for a in range(0, batch.num_rows, step):
                b = min(a + step, batch.num_rows)
                lo, hi = np.searchsorted(doc, [a, b])
                times = uses[code[lo:hi]]
                at = np.repeat(first[code[lo:hi]] - np.cumsum(times) + times, times) + np.arange(times.sum())
                score = np.zeros((len(items), b - a), np.int64)
                cell = item[at] * (b - a) + np.repeat(doc[lo:hi] - a, times)
                value = weight[at] * np.repeat(impact[lo:hi], times)
                if value.sum(dtype=np.float64) < 2**53:  # then sums of doubles are exact
                    score += np.bincount(cell, value, score.size).astype(np.int64).reshape(score.shape)
                else:
                    np.add.at(score.reshape(-1), cell, value)
                # In the order of ids; what held its place before has to be beaten or tied.
                bar = best[:, -1, 0] if best.shape[1] == k else np.ones(len(items), np.int64)
                for i in np.flatnonzero(score.max(1) >= bar):
                    s = score[i]
                    near = np.flatnonzero(s >= max(1, bar[i], np.partition(s, -k)[-k] if len(s) > k else 1))
                    near = near[np.argsort(-s[near], kind="stable")[:k]]
                    new = np.stack([s[near], ids[a + near], row[a + near]], 1)
                    old = best[i][best[i, :, 0] > 0]
                    both = np.concatenate([old, new])
                    both = both[np.lexsort((both[:, 2], both[:, 1], -both[:, 0]))[:k]]
                    if best.shape[1] < k:
                        best = np.concatenate([best, np.zeros((len(items), k - best.shape[1], 3), np.int64)], 1)
                    best[i, : len(both)] = both
        i, j = np.nonzero(best[:, :, 0]) if best.shape[1] else (np.zeros(0, int), np.zeros(0, int))
        out = best[i, j]
        found = pa.array(out[:, 1] if len(out) else np.zeros(0, np.int64), mask=(out[:, 1] == least) if len(out) else None)
        yield pa.RecordBatch.from_arrays([pa.array(items[i].astype(np.int64)), found, pa.array(out[:, 2]), pa.array(out[:, 0])], names=["item", "id", "row", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score for each item, equal scores by
    ascending doc_id (null first), then by row; documents with score 0 never.

    Rows of either table are items and documents of their own, even if they share an id or
    have none; such items have a ranking each. Null and empty texts have no terms: they find nothing
    and aren't counted. Repeated terms of an item count once. Texts of any length are read
    whole. Empty tables give no rows; other columns are ignored.
    """
    key = F.monotonically_increasing_id().alias("row")
    asked = materialize(forward(items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text"), key)), "queries")
    entries = asked.select(F.col("row").alias("item"), F.explode("terms").alias("term"))
    wanted = materialize(entries.select("term").distinct(), "query-terms")
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), key)
    index = materialize(forward(keyed, term_filter(wanted, filter_size(wanted.count()))), "index")
    total = index.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    size, length = total["docs"], max(1, total["terms"])
    postings = postings_of(index, size, length)
    cuts = materialize(cut_tiers(postings, tiers).join(wanted, "term", "left_semi"), "tiers")
    weight = F.floor(1000 * F.log((2 * F.lit(size) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    asked_terms = materialize(entries.join(cuts.withColumn("weight", weight), "term").where("weight > 0"), "weights")
    tiered = _write_tiers(postings, cuts, len(tiers))
    left, found = asked_terms, None
    for t in range(1, len(tiers) + 1):
        got = materialize(answer(left, tiered.where(F.col("tier") <= t), index, f"rest{t}", k, size, length), f"tier{t}")
        found = got if found is None else found.unionByName(got)
        left = materialize(left.join(got.select("item").distinct(), "item", "left_anti"), f"left{t}")
        if left.isEmpty():
            break
    else:
        found = found.unionByName(_last(left, index, k, size, length))
    best = _best(found.where("score > 0"), k)
    named = asked.select(F.col("row").alias("item"), F.col("id").alias("item_id"))
    return best.join(named, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def _write_tiers(postings: DataFrame, cuts: DataFrame, n: int) -> DataFrame:
    """The postings in tiers 1 to n with their tier, a folder each. A table of fixed size tells
    of most others before the join that no tier wants them."""
    spark = postings.sparkSession
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    lows = cuts.select(slot("term").alias("s"), F.col(f"least{n}").alias("v"))
    every = spark.range(SLOTS).select(F.col("id").cast("int").alias("s"), F.lit(SCALE).cast("long").alias("v"))
    low = lows.unionByName(every).groupBy("s").agg(F.min("v").alias("v"))
    table = low.agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "v"))), lambda x: x["v"]).alias("t")).scalar()
    kept = postings.where(F.col("impact") >= F.get(table, slot("term"))).join(cuts.select("term", *[f"least{k}" for k in range(1, n + 1)]), "term")
    tier = F.coalesce(*[F.when(F.col("impact") >= F.col(f"least{k}"), F.lit(k)) for k in range(1, n + 1)])
    path = new_path(spark, "postings")
    kept = kept.select("term", "id", "row", "impact", tier.alias("tier")).where("tier is not null")
    kept.write.option("compression", "zstd").partitionBy("tier").parquet(path)
    return spark.read.schema("term string, id long, row long, impact long, tier int").parquet(path)


def _last(left: DataFrame, index: DataFrame, k: int, docs: int, terms: int) -> DataFrame:
    """All documents against the items of left, block by block; a block is of checked size."""
    n = max(1, -(-left.count() // BLOCK_TERMS))
    while True:
        dealt = left.select("item", "term", "weight", F.pmod(F.xxhash64("item"), F.lit(n)).alias("block"))
        sizes = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("c"), F.countDistinct("item").alias("items")).collect()  # a row a block
        if all(r["c"] <= 4 * BLOCK_TERMS or r["items"] == 1 for r in sizes):
            break
        n *= 2
    found = None
    for r in sizes:
        block = dealt.where(F.col("block") == r["block"]).select("item", "term", "weight").toArrow()
        got = index.where(F.size("terms") > 0).mapInArrow(whole_index(block, k, docs, terms), "item long, id long, row long, score long")
        found = got if found is None else found.unionByName(got)
    return materialize(found, "whole-index")
