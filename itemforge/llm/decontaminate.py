"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask names the token places of a short span that count; the others are ignored.
The hash of the counted tokens is a seed. Seeds of documents and of benchmark items
meet in a join; around each hit the tokens of both are laid side by side, and the
document is contaminated if some aligned window agrees in enough places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_filter

#: Tokens of a window that must agree, but for SUBSTITUTIONS of them.
WINDOW = 13
SUBSTITUTIONS = 3
#: Fixed masks: any WINDOW places of which any SUBSTITUTIONS differ hold one of them
#: whole (tests/llm/test_decontaminate.py tries all cases).
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 8), (0, 1, 2, 6, 8))
SPAN = 1 + max(m[-1] for m in MASKS)
#: Places shown before and after the start of a hit, so that every window around it fits.
BEFORE, AFTER = WINDOW - 6, WINDOW
#: Shorter items are found as a whole only, each length by a mask of its own.
SHORT_ITEM = SPAN
#: Items from SHORT_ITEM to less than WINDOW tokens may differ in two: of three parts of so many
#: tokens one is whole then.
PART = SHORT_ITEM // 3
#: Bits of the seed filter: a fixed size, whatever the benchmark.
FILTER_BITS = 1 << 22


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def _at(k: int) -> Column:
    """Token i + k of the row's tokens; null outside."""
    return F.get("t", F.col("i") + k)


def _seed(name: int, mask: tuple[int, ...]) -> Column:
    """Null where the mask leaves the tokens. Of hashes of tokens, each made once a text."""
    return F.when(F.col("i") + mask[-1] < F.col("n"), F.xxhash64(F.lit(name), *[F.get("h", F.col("i") + k) for k in mask]))


def _masks(lengths: list[int]) -> list[tuple[int, tuple[int, ...], Column]]:
    """(name, mask, items that need it), for items of these lengths."""
    n = F.col("n")
    out = [(j, m, n >= SHORT_ITEM) for j, m in enumerate(MASKS)] if any(k >= SHORT_ITEM for k in lengths) else []
    if any(SHORT_ITEM <= k < WINDOW for k in lengths):
        out.append((len(MASKS), tuple(range(PART)), (n >= SHORT_ITEM) & (n < WINDOW)))
    return out + [(100 + k, tuple(range(k)), (n == k) & (F.col("i") == 0)) for k in lengths if 0 < k < SHORT_ITEM]


def _around() -> Column:
    """The tokens around place i; null outside."""
    return F.array(*[_at(k) for k in range(-BEFORE, AFTER)])


def _places(df: DataFrame, span: int) -> DataFrame:
    """A row for each place of t at which a mask of this span can start; a row with a null place for
    shorter texts. (A filter on their length, or the one that Spark infers from explode(), would part texts
    into tokens a second time.)"""
    df = df.withColumn("h", F.transform("t", lambda x: F.xxhash64(x))).withColumn("n", F.size("t"))
    return df.withColumn("i", F.explode_outer(F.when(F.col("n") >= span, F.sequence(F.lit(0), F.col("n") - span))))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> DataFrame:
    """(doc_id, item_id, n_match, window_tokens, doc_token, item_token): one row per
    document and benchmark item that overlap, with the best aligned window.

    A window holds `window` tokens, or the whole item if it has fewer, and at most
    `substitutions` of them differ (for shorter items in proportion, and none for items of
    fewer than SHORT_ITEM tokens). n_match of window_tokens places agree; doc_token and
    item_token are where the seed stands. Masks for short items are only looked up
    where there are such items.

    Null texts have no tokens; an item without tokens overlaps nothing. A text of any length
    is read whole. Rows that share an id count as one document or item; a null id is an
    id like any other. Ties between windows go to the earliest place. Empty tables
    give no rows. Other columns are ignored.

    Every place of every document is looked up in a filter of fixed size, so only
    hits are shuffled; a join by seed, in which Spark can split hot seeds, follows.
    """
    if window > WINDOW or substitutions > SUBSTITUTIONS:
        raise ValueError(f"the masks hold for windows of {WINDOW} and {SUBSTITUTIONS} substitutions at most")
    items = benchmark.select(F.col(item_id_col).alias("item_id"), tokens(F.col(item_text_col)).alias("t"))
    # Lengths that ask for other masks: at most one more than WINDOW.
    lengths = [r["k"] for r in items.select(F.least(F.size("t"), F.lit(WINDOW)).alias("k")).distinct().collect() if r["k"]]
    masks = _masks(lengths or [WINDOW])
    span = min(m[-1] + 1 for _, m, _ in masks)
    seeds = lambda ours: F.explode(F.array(*[F.when(need, _seed(j, m)) if ours else _seed(j, m) for j, m, need in masks]))
    items = _places(items, span).withColumn("seed", seeds(True)).where("seed is not null")
    items = items.select("seed", "item_id", F.col("i").alias("item_token"), F.least("n", F.lit(window)).alias("window_tokens"), _around().alias("theirs"))
    maybe = hash_filter(items.select("seed"), FILTER_BITS)
    found = _places(docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("t")), span)
    # explode() evaluates each seed once; what stands behind the filter runs for hits only.
    found = found.withColumn("seed", seeds(False)).where(maybe(F.col("seed")))
    found = found.select("doc_id", F.col("i").alias("doc_token"), _around().alias("ours"), "seed")
    pairs = found.join(items, "seed")
    # A bit for each place that agrees; explode() of the one value makes it once a pair. Then all windows that
    # hold the place of the hit and fit in what is shown.
    agree = [F.when(F.get("ours", F.lit(k)) == F.get("theirs", F.lit(k)), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(BEFORE + AFTER)]
    pairs = pairs.withColumn("agree", F.explode(F.array(reduce(Column.bitwiseOR, agree))))
    counts = [F.bit_count(F.col("agree").bitwiseAND(((1 << window) - 1) << k)) for k in range(BEFORE + AFTER - window + 1)]
    pairs = pairs.withColumn("n_match", F.greatest(*counts))
    allowed = F.when(F.col("window_tokens") < SHORT_ITEM, 0).otherwise(F.floor(F.lit(substitutions) * F.col("window_tokens") / window))
    pairs = pairs.where(F.col("n_match") >= F.col("window_tokens") - allowed)
    best = F.min(F.struct((-F.col("n_match")).alias("m"), "doc_token", "item_token", "window_tokens")).alias("b")
    out = pairs.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", (-F.col("b.m")).alias("n_match"), "b.window_tokens", "b.doc_token", "b.item_token")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that overlap no benchmark item, unchanged. Rows that share
    the id of a contaminated one go with it."""
    bad = find_contamination(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]), "left_anti")
