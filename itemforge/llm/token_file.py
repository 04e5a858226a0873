"""Token ids as fixed-width bit-packed blocks.

A token file is a folder of two Parquet tables:

* ``blocks``: shard int, block int, docs array<long> (ids of the documents),
  offsets array<int> (first id of each document inside the block, and the number
  of ids at the end), bits int, payload binary (the ids, ``bits`` bits each, least
  significant bit first, padded to whole 64-bit little-endian words);
* ``shards``: shard int, first long (ids in all shards before it), n_tokens long.

Shards are ranges of ascending doc_id, and so are the blocks of a shard. A block
ends with the document that brings it to BLOCK ids or more, so any document is
read from one block by its offsets. Spark's committer publishes the files, so
lost executors and repeated task attempts leave no partial block behind.
"""

from __future__ import annotations

import string
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, new_path, worker_store

BLOCK = 1 << 18
#: Letters that are encoded at a time, and at least a document.
LETTERS = 1 << 22


def bits_for(vocab: int) -> int:
    """The fewest bits that tell vocab ids apart."""
    return max(1, int(vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """64 ids fill exactly `bits` words: each of the 64 places has a fixed word and
    shift, so every step works on all groups of 64 at once. 8, 16 or 32 bits are whole
    numbers of that width."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes().ljust(-(-len(ids) * bits // 64) * 8, b"\0")
    n = -(-len(ids) // 64)
    grid = np.zeros((n, 64), np.uint64)
    grid.reshape(-1)[: len(ids)] = ids
    words = np.zeros((n, bits), "<u8")
    for k in range(64):
        w, s = divmod(k * bits, 64)
        words[:, w] |= grid[:, k] << np.uint64(s)
        if s + bits > 64:
            words[:, w + 1] |= grid[:, k] >> np.uint64(64 - s)
    return words.reshape(-1)[: -(-len(ids) * bits // 64)].tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a payload, as uint32; only their words are touched."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}")[start:stop].astype(np.uint32)
    words = np.frombuffer(payload, "<u8")
    at = np.arange(start, stop, dtype=np.uint64) * np.uint64(bits)
    w, s = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    low = words[w] >> s
    over = s + np.uint64(bits) > np.uint64(64)
    if over.any():
        low[over] |= words[w[over] + 1] << (np.uint64(64) - s[over])
    return (low & np.uint64((1 << bits) - 1)).astype(np.uint32)


def chunk_encoder(tokenizer_json: str) -> Callable[[list[str]], list[bytes]]:
    """Encodes whole texts as uint32 bytes, exactly as Tokenizer.encode does.

    The tokenizer's pre-tokens never cross white space and its normalizer works
    on each character, so a text is its white-space chunks one after the other.
    Arrow parts texts into chunks and numbers the distinct ones, each of which is
    encoded once and kept in the worker's memo; their ids are taken by number. Most
    are a run of letters, perhaps with marks behind it: these are two pre-tokens, and
    runs that are normalized already go to the library's model without normalizer
    and pattern. Texts for which this does not hold surely are encoded whole.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    store = worker_store("chunks:" + tokenizer_json[:64] + str(len(tokenizer_json)))
    if "tok" not in store:
        store["tok"], store["memo"] = Tokenizer.from_str(tokenizer_json), Memo()
        store["runs"] = Tokenizer(store["tok"].model)
        store["runs"].pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix, vocab = getattr(store["tok"].model, "end_of_word_suffix", None), store["tok"].get_vocab()
        store["last"] = np.zeros(max(vocab.values()) + 1, bool)  # the ids that end a pre-token
        store["last"][[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
    tok, memo, runs, last = store["tok"], store["memo"], store["runs"], store["last"]

    def as_bytes(ids) -> bytes:
        return np.array(ids, np.uint32).tobytes()

    def keep_cut(part: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        data, ends = ids.tobytes(), (ends * 4).tolist()
        memo.keep_all(part, [data[a:b] for a, b in zip([0, *ends], ends)])

    def learn(new: list[str]) -> None:
        """Encodes all new chunks as one text and cuts the ids at chunk starts."""
        for at in range(0, len(new), 2000):
            part = new[at : at + 2000]
            e = tok.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([len(c) + 1 for c in part])
            first = np.array([o[0] for o in e.offsets], np.int64)
            keep_cut(part, np.array(e.ids, np.uint32), np.searchsorted(first, starts))

    def learn_runs(new: list[str]) -> None:
        """The same for runs of letters, one pre-token each: ids are cut behind those that end one."""
        for at in range(0, len(new), 2000):
            part = new[at : at + 2000]
            ids = np.array(runs.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(last[ids]) + 1
            if len(ends) == len(part):
                keep_cut(part, ids, ends)
            else:  # a vocabulary without such ends
                learn(part)

    def encode(texts: list[str]) -> list[bytes]:
        memo.turn()
        plain: list[str | None] = []
        for t in texts:
            if "<|" in t or any(c in t for c in "\x1c\x1d\x1e\x1f"):
                plain.append(None)
                continue
            try:  # Latin-1 holds no combining mark and no letter whose case depends on its neighbours
                t.encode("latin-1")
                t = t.lower()
                plain.append(" ".join(t.split()) if "\x85" in t or "\xa0" in t else t)
            except UnicodeEncodeError:
                plain.append(" ".join(t.split()) if unicodedata.is_normalized("NFC", t) else None)
        parts = pc.ascii_split_whitespace(pa.array([t for t in plain if t is not None], pa.string()))
        numbers = parts.flatten().dictionary_encode()
        chunks = numbers.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes five times as long
        other, letters, marked = [], [], []
        for c in memo.unknown(chunks):
            run = c.rstrip(string.punctuation)
            if not (run.isalpha() and (run.isascii() or max(run) <= "\xff") and run == run.lower()):
                other.append(c)
            elif len(run) == len(c):
                letters.append(c)
            else:
                marked.append((c, run, c[len(run) :]))
        learn([c for c in other if c])
        memo.keep("", b"")  # before leading white space and after trailing one
        learn_runs(letters)
        learn_runs(memo.unknown({run for _, run, _ in marked}))
        learn(memo.unknown({marks for _, _, marks in marked}))
        known = memo.young
        memo.keep_all([c for c, _, _ in marked], [known[run] + known[marks] for _, run, marks in marked])
        taken = pa.array([known[c] for c in chunks], pa.large_binary()).take(numbers.indices)
        _, offsets, data = taken.buffers()
        ends = np.frombuffer(offsets, np.int64)[parts.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        found = iter([data[a:b].tobytes() for a, b in zip(ends, ends[1:])])
        return [next(found) if p is not None else as_bytes(tok.encode(t, add_special_tokens=False).ids) for t, p in zip(texts, plain)]

    return encode


BLOCKS_SCHEMA = "shard int, block int, docs array<long>, offsets array<int>, bits int, payload binary"
_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("docs", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("bits", pa.int32()), ("payload", pa.binary())])


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends end_id, and writes a token file at path.

    A null text counts as empty: it is the end id alone. A null id sorts first.
    Rows with the same id follow each other, ordered by their text. An empty table
    writes a file without blocks. Other columns are ignored.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary, of fixed size
    bits = bits_for(max(Tokenizer.from_str(shared.value).get_vocab_size(), end_id + 1))

    def encode_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = chunk_encoder(shared.value)
        shard, block = TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32).tobytes()
        ids_in: list = []
        data: list[bytes] = []
        size = 0

        def flush():
            nonlocal block, ids_in, data, size
            n = np.array([len(d) // 4 for d in data], np.int64)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            payload = pack(np.frombuffer(b"".join(data), np.uint32), bits)
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([ids_in], _ARROW.field("docs").type), pa.array([offsets], _ARROW.field("offsets").type), pa.array([bits], pa.int32()), pa.array([payload], pa.binary())], schema=_ARROW
            )
            block, ids_in, data, size = block + 1, [], [], 0
            return out

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            full = np.cumsum([len(t) for t in texts]) // LETTERS
            cuts = [0, *(np.flatnonzero(full[1:] != full[:-1]) + 1).tolist(), len(texts)]
            for at, to in zip(cuts, cuts[1:]):
                for i, b in zip(ids[at:to], encode(texts[at:to])):
                    ids_in.append(i)
                    data.append(b + end)
                    size += len(b) // 4 + 1
                    if size >= BLOCK:
                        yield flush()
        if data:
            yield flush()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    rows.mapInArrow(encode_partition, BLOCKS_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    sizes = spark.read.schema(BLOCKS_SCHEMA).parquet(f"{path}/blocks").select("shard", F.element_at("offsets", -1).cast("long").alias("n"))
    per = sizes.groupBy("shard").agg(F.sum("n").alias("n_tokens"))
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a shard
    per.select("shard", before.alias("first"), "n_tokens").write.parquet(f"{path}/shards")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, shard, block, ids_crc32) per document, from the
    unpacked blocks. Payloads stay in the task that reads them; only the rows of
    figures meet the block starts."""

    def unpack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["bits"], 0, row["offsets"][-1])
                off = row["offsets"]
                n = len(row["docs"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["docs"], pa.int64()),
                        pa.array(off[:-1], pa.int64()),
                        pa.array(np.diff(off), pa.int64()),
                        pa.array([row["shard"]] * n, pa.int32()),
                        pa.array([row["block"]] * n, pa.int32()),
                        pa.array([zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(off, off[1:])], pa.int64()),
                    ],
                    names=["doc_id", "at", "n_tokens", "shard", "block", "ids_crc32"],
                )

    blocks = spark.read.schema(BLOCKS_SCHEMA).parquet(f"{path}/blocks")
    shards = spark.read.schema("shard int, first long, n_tokens long").parquet(f"{path}/shards").drop("n_tokens")
    # The first id of each block: counts of the blocks before it in its shard.
    n = F.element_at("offsets", -1).cast("long")
    sizes = blocks.select("shard", "block", n.alias("n"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.withColumn("w", within).join(shards, "shard").select("shard", "block", (F.col("first") + F.col("w")).alias("first"))
    docs = blocks.mapInArrow(unpack_blocks, "doc_id long, at long, n_tokens long, shard int, block int, ids_crc32 long")
    return docs.join(firsts, ["shard", "block"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "shard", "block", "ids_crc32")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with this id: random access by the block offsets."""
    blocks = spark.read.schema(BLOCKS_SCHEMA).parquet(f"{path}/blocks").where(F.array_contains("docs", doc_id))
    out = []
    for row in blocks.orderBy("shard", "block").toLocalIterator():
        for k, d in enumerate(row.docs):
            if d == doc_id:
                out.append(unpack(row.payload, row.bits, row.offsets[k], row.offsets[k + 1]).tolist())
    return out


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Writes the token file of docs and reads it back: (doc_id, start, n_tokens,
    ids_crc32, shard, block), start being the ids of all documents before it."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "block")
