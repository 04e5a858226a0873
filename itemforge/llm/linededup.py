"""Line dedup by a deletion-neighbourhood join.

A line is the run of its lower-cased words. Lines are duplicates if they are equal
or, when long enough, if one word put in, taken out or replaced makes them equal.
Each line's variants (itself, and itself without each of its words) are hashed; equal
hashes meet in a grouping, where only the earliest line of a hash matters: a hash with
a hole at place i is shared by lines that differ at most in word i, so all of its lines
duplicate the earliest; a hash without a place is shared by one line and its shortenings.
So no pairs of a group are made. Pairs (line, earliest) are then verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_size, free_name, hash_filter, materialize

#: Shorter lines are never touched: blank ones.
MIN_WORDS = 1
#: Letters that are words of their own, as their scripts put no spaces: Thai, Lao, Burmese,
#: Khmer, kana and Han.
UNSPACED = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"
#: From so many words on a line has an edit bound of one word.
FUZZY_WORDS = 8
#: Variants that one task makes, about.
VARIANTS_PER_TASK = 400_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
HOLE, WHOLE, SHORT = 0, 1, 2


def _lines_of(text: Column) -> Column:
    """The lines of a text, with spaces around each letter of an unspaced script: once a text, not once a line."""
    # One range is cheaper to look for than the six it holds.
    may_be = (F.octet_length(text) > F.char_length(text)) & text.rlike(r"[\x{0E00}-\x{9FFF}]")
    apart = F.when(may_be, F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text)
    return F.posexplode(F.split(apart, "\n")).alias("line_no", "line")


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), r"(?U)\s+"), "")


def _start(doc_id: Column, text: Column) -> Column:
    """One number that orders documents, with room for their lines: by id, a null one first,
    then by a hash of the text, which parts rows that share an id."""
    doc = F.coalesce(doc_id.cast("decimal(20,0)"), F.lit("-9223372036854775809").cast("decimal(20,0)"))
    h = F.pmod(F.xxhash64(text), F.lit(10**8)).cast("decimal(8,0)") * F.lit(10**10).cast("decimal(11,0)")
    return (doc * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,0)") + h.cast("decimal(38,0)")


def _place(start: Column, line_no: Column) -> Column:
    return (start + line_no.cast("decimal(10,0)")).cast("decimal(38,0)")


def _text_hash(text: Column) -> Column:
    """96 bits that tell the texts of rows with the same id apart."""
    return F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"))


def _halves() -> list[Column]:
    """Hashes of the first and the last half of a line's words, for lines of n words
    and of n - 1. Two lines one word apart agree in at least one of the four: the
    word stands in one half, so the other is the same in both."""
    out = []
    for cut in (0, 1):
        c = F.col("n") - cut
        p = F.floor(c / 2).cast("int")
        out.append(F.xxhash64(F.lit(0), c, F.slice("w", F.lit(1), p)))
        out.append(F.xxhash64(F.lit(1), c, F.slice("w", F.col("n") - (c - p) + 1, c - p)))
    return out


def variant_hashes(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lines of word hashes, one after the other: which line, role and hash of
    each variant. Polynomial hashes make the work linear in the words."""
    n = np.diff(offsets)
    line = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(values)) - np.repeat(offsets[:-1], n)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(n.max()), _BASE, np.uint64)]))
        term = values.astype(np.uint64) * power[j]
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
        start, total = upto[offsets[:-1]], upto[offsets[1:]] - upto[offsets[:-1]]
        before = upto[:-1] - start[line]
        hole = _mix(total[line] - term + j.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), n[line])
        short = _mix(before + (total[line] - before - term) * np.uint64(_INVERSE), n[line] - 1 + (1 << 40))
        whole = _mix(total, n + (1 << 40))
    roles = np.repeat(np.array([HOLE, SHORT, WHOLE], np.int8), [len(hole), len(short), len(whole)])
    return np.concatenate([line, line, np.arange(len(n))]), roles, np.concatenate([hole, short, whole])


def _mix(h: np.ndarray, salt: np.ndarray) -> np.ndarray:
    h = h ^ (salt.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _emit_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            lists = part.column(1)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy()[offsets[0] : offsets[-1]]
            line, role, key = variant_hashes(values.view(np.uint64), (offsets - offsets[0]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(line)), pa.array(role), pa.array(key)], names=["place", "role", "key"])


def _near_lines(docs: DataFrame, distinct: DataFrame, fuzzy_words: int) -> DataFrame:
    """(place, k1, pivot): distinct lines, by their first place and their hash (rows that
    share an id share places), that have an earlier line one word apart, with the
    earliest such."""
    # Lines that agree with no other in a half can have no line one word apart. Which
    # halves are shared is kept in a filter, so that only sums over halves are shuffled.
    halves = distinct.where(F.col("n") >= fuzzy_words).select("k1", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("half")
    shared = materialize(shared, "halves")
    is_shared = hash_filter(shared, filter_size(shared.count()))
    ours = distinct.where(F.col("n") >= fuzzy_words).select("place", "k1", "halves").where(reduce(or_, [is_shared(F.get("halves", F.lit(i))) for i in range(4)])).select("place", "k1")
    ours = materialize(ours, "lines-near")
    # The words of these lines are read from the documents again; the filter keeps other lines out of the join.
    is_ours = hash_filter(ours.select(F.xxhash64("place").alias("h")), filter_size(ours.count()))
    lines = docs.select("_start", _lines_of(F.col("_text")))
    lines = lines.withColumn("p", _place(F.col("_start"), F.col("line_no"))).where(is_ours(F.xxhash64("p")))
    lines = lines.select("p", words_of(F.col("line")).alias("w")).select("p", F.xxhash64("w").alias("k"), F.transform("w", lambda w: F.xxhash64(w)).alias("w"))
    lines = lines.join(ours, (F.col("p") == F.col("place")) & (F.col("k") == F.col("k1"))).select("place", "w", "k1").distinct()
    lines = materialize(lines.where(F.size("w") >= fuzzy_words), "lines-words")
    # A line becomes twice as many variants as it has words, so lines are dealt by what they become.
    made = 2 * (lines.agg(F.sum(F.size("w"))).first()[0] or 0)
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-made // VARIANTS_PER_TASK))
    variants = lines.select("place", "w").repartition(tasks, "place").mapInArrow(_emit_variants, "place decimal(38,0), role byte, key long")
    first = [F.min(F.when(F.col("role") == r, F.col("place"))).alias(f"m{r}") for r in (HOLE, WHOLE, SHORT)]
    met = variants.groupBy("key").agg(F.min("place").alias("lo"), F.max("place").alias("hi"), *first).where("lo <> hi").drop("lo", "hi")
    met = materialize(met, "lines-met")
    has_met = hash_filter(met.select("key"), filter_size(met.count()))
    pivot = F.when(F.col("role") == HOLE, F.col(f"m{HOLE}")).when(F.col("role") == WHOLE, F.col(f"m{SHORT}")).otherwise(F.col(f"m{WHOLE}"))
    pairs = variants.where(has_met(F.col("key"))).join(met, "key").select("place", pivot.alias("pivot")).where("pivot < place").distinct()
    # The edit distance: behind their common beginning one word is skipped in the longer line, or in both.
    x = lines.select("place", "k1", F.col("w").alias("x"))
    y = lines.select(F.col("place").alias("pivot"), F.col("w").alias("y"))
    both = pairs.join(x, "place").join(y, "pivot")
    lead = F.coalesce(F.array_position(F.zip_with("x", "y", lambda a, b: ~a.eqNullSafe(b)), True) - 1, F.lit(0)).cast("int")
    gap = F.size("x") - F.size("y")
    both = both.withColumn("lead", lead)
    rest = lambda c, skip: F.slice(c, F.col("lead") + 1 + skip, F.greatest(F.size(c), F.lit(1)))
    ok = F.when(gap == 0, rest("x", 1) == rest("y", 1)).when(gap == 1, rest("x", 1) == rest("y", 0)).when(gap == -1, rest("x", 0) == rest("y", 1)).otherwise(False)
    return both.where(ok).groupBy("place", "k1").agg(F.min("pivot").alias("pivot"))


def find_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, fuzzy_words: int = FUZZY_WORDS) -> DataFrame:
    """(doc_id, text_hash struct, dropped array<int>): documents with lines to drop, and
    their numbers. Rows that share an id, or have none, are told apart by text_hash, that
    of their text; rows with the same id and text lose the same lines.

    A line is dropped if an equal line stands earlier (a smaller doc_id, or the same
    and a smaller line number), or if the earliest line equal to it has an earlier
    line one word apart. Lines of fewer than min_words words are never dropped, those
    of fewer than fuzzy_words only for equal ones. Case and white space don't count.

    Null texts have no lines. A null id counts as the earliest. Of rows that share an id the one
    with the smaller hash of its text is earlier; rows with one id and text are equally early.
    A line of any length is compared whole; its work is linear in its words.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")
    # Below the explode: once a text, not once a line.
    rows = rows.withColumns({"text_hash": _text_hash(F.col("_text")), "_start": _start(F.col("_id"), F.col("_text"))})
    lines = rows.select("_id", "_start", "text_hash", _lines_of(F.col("_text")))
    # explode() evaluates the words once; a filter on their number would be evaluated below, again.
    lines = lines.select("_id", "_start", "text_hash", "line_no", F.explode(F.array(words_of(F.col("line")))).alias("w")).withColumn("n", F.size("w")).where(F.col("n") >= min_words)
    place = _place(F.col("_start"), F.col("line_no"))
    halves = F.when(F.col("n") >= fuzzy_words, F.array(*_halves()))
    lines = lines.select(F.col("_id").alias("doc_id"), "text_hash", "line_no", place.alias("place"), F.xxhash64("w").alias("k1"), F.hash("w").alias("k2"), "n", halves.alias("halves"))
    lines = materialize(lines, "lines")
    first = F.min(F.struct("place", "n", "halves")).alias("first")
    seen = lines.groupBy("k1", "k2").agg(first, F.count(F.lit(1)).alias("times")).select("k1", "k2", "first.*", "times")
    seen = materialize(seen, "lines-seen")
    near = _near_lines(rows, seen, fuzzy_words).select("place", "k1", F.lit(True).alias("near"))
    keys = seen.select("k1", "k2", "place", "times").join(near, ["place", "k1"], "left").where("times > 1 or near")
    keys = materialize(keys.select("k1", "k2", F.col("place").alias("first"), F.coalesce("near", F.lit(False)).alias("near")), "lines-keys")
    is_key = hash_filter(keys.select("k1"), filter_size(keys.count()))
    gone = lines.where(is_key(F.col("k1"))).select("doc_id", "text_hash", "line_no", "place", "k1", "k2").join(keys, ["k1", "k2"]).where("near or place > first")
    return gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, fuzzy_words: int = FUZZY_WORDS, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with text_col cut to the lines that stay, and two columns named by counts,
    the lines of the text and those cut (longs; they replace columns of these names). All rows stay; a null
    text stays null with 0 lines. An empty table gives no rows."""
    gid, ghash, dropped_col = [free_name(docs, c) for c in ("_gone", "_hash", "_dropped")]
    gone = find_duplicate_lines(docs, id_col, text_col, min_words, fuzzy_words).select(F.col("doc_id").alias(gid), F.col("text_hash").alias(ghash), F.col("dropped").alias(dropped_col))
    columns = [c for c in docs.columns if c not in counts]
    kinds = dict(docs.dtypes)
    # What is dropped grows with the documents, so it is never broadcast.
    rows = docs.select(*[F.col(c) for c in columns]).join(gone.hint("merge"), docs[id_col].cast("long").eqNullSafe(F.col(gid)) & (_text_hash(docs[text_col]) == F.col(ghash)), "left").drop(gid, ghash)
    k = columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, dropped = batch.column(k).to_pylist(), batch.column(len(columns)).to_pylist()
            lines, removed = [], []
            for i, (t, d) in enumerate(zip(texts, dropped)):
                n = 0 if t is None else t.count("\n") + 1
                took = 0
                if d and n:
                    drop = set(d)
                    kept = [x for j, x in enumerate(t.split("\n")) if j not in drop]
                    took = n - len(kept)
                    texts[i] = "\n".join(kept)
                lines.append(n)
                removed.append(took)
            out = [batch.column(c) for c in range(len(columns))]
            out[k] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*out, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], names=[*columns, *counts])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + "".join(f", `{c}` long" for c in counts)
    return rows.mapInArrow(cut, schema)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """dedup_lines() with the columns of docs, whatever their names: rows that lost lines
    and have no word left go, and size_col, if there is one, follows the text. Null and
    empty texts lose nothing and stay; rows that share an id, or have none, are told apart
    by their text; an empty table gives no rows."""
    counts = (free_name(docs, "_lines"), free_name(docs, "_cut"))
    out = dedup_lines(docs, id_col, text_col, counts=counts)
    cut = F.col(counts[1])
    out = out.where((cut == 0) | F.col(text_col).rlike(r"(?U)\w"))
    if size_col in docs.columns:
        kind = dict(docs.dtypes)[size_col]
        out = out.withColumn(size_col, F.when(cut > 0, F.char_length(text_col)).otherwise(F.col(size_col)).cast(kind))
    return out.select(*[c for c in docs.columns])
