"""Byte-level BPE: encoding and decoding by a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary resolves pre-tokens that are
vocabulary entries. Tier 2: other pre-tokens are merged with a heap of candidate
pairs over a doubly linked list of byte runs.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, worker_store

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a .tiktoken file by rank; a missing rank is empty bytes."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def hash_all(keys: list[bytes]) -> np.ndarray:
    """A 64-bit polynomial hash of each key (none empty), all at once."""
    if not keys:
        return np.zeros(0, np.uint64)
    n = np.array([len(k) for k in keys])
    starts = np.cumsum(n) - n
    data = np.frombuffer(b"".join(keys), np.uint8).astype(np.uint64) + np.uint64(1)
    power = np.cumprod(np.full(int(n.max()), 0x9E3779B97F4A7C15, np.uint64))
    place = np.arange(len(data)) - np.repeat(starts, n)
    return _mix(np.add.reduceat(data * power[place], starts))


class PerfectHash:
    """Minimal perfect hash of distinct keys (hash and displace): a key's bucket
    has a displacement that sends all keys of the bucket to free slots; there are
    as many slots as keys."""

    def __init__(self, keys: list[bytes]):
        h = hash_all(keys)
        self.n = len(keys)
        if len(np.unique(h)) < self.n:
            raise ValueError("two keys have one hash, so no displacement parts them")
        self.buckets = max(1, self.n // 4)
        self.shift = np.zeros(self.buckets, np.int64)
        self.key_at = np.full(self.n, -1, np.int64)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        end = np.cumsum(size)
        tries = np.arange(1, 257, dtype=np.uint64)
        for b in np.argsort(-size, kind="stable"):
            k = order[end[b] - size[b] : end[b]]
            if len(k) < 2:
                break
            base = np.uint64(0)
            while True:
                slots = self._slots(h[k][None, :], (tries + base)[:, None])
                ok = (self.key_at[slots] < 0).all(1)
                spread = np.sort(slots, 1)
                ok &= (spread[:, 1:] != spread[:, :-1]).all(1)
                if ok.any():
                    t = int(ok.argmax())
                    self.shift[b] = int(tries[t] + base)
                    self.key_at[slots[t]] = k
                    break
                base += np.uint64(256)
        free = iter(np.flatnonzero(self.key_at < 0))
        for b in np.flatnonzero(size == 1):  # a bucket of one key names its slot
            slot = next(free)
            self.shift[b] = -1 - slot
            self.key_at[slot] = order[end[b] - 1]

    def _slots(self, h, shift):
        return (_mix(h + shift * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The number of the only key that each given key can be equal to."""
        h = hash_all(keys)
        s = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(s < 0, -1 - s, self._slots(h, np.maximum(s, 0).astype(np.uint64)))
        return self.key_at[slot]


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE ids of word: merge the adjacent pair of lowest rank, the leftmost of
    equals, until no pair is in the vocabulary."""
    n = len(word)
    rank_of = ranks.get
    stop = list(range(1, n + 1))  # where the run that begins at i ends
    before = list(range(-1, n))  # where the run before the one that begins at i begins
    pair = [rank_of(word[i : i + 2], -1) for i in range(n - 1)]  # rank of the run that begins at i with the next; -1: none
    pair.append(-1)
    heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
    heapify(heap)
    while heap:
        r, i = divmod(heappop(heap), n)
        if pair[i] != r:
            continue  # one side has been merged since
        j = stop[i]
        end = stop[j]
        stop[i], pair[j] = end, -1
        before[end] = i
        pair[i] = r = rank_of(word[i : stop[end]], -1) if end < n else -1
        if r >= 0:
            heappush(heap, r * n + i)
        if (p := before[i]) >= 0:
            pair[p] = r = rank_of(word[p:end], -1)
            if r >= 0:
                heappush(heap, r * n + p)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : stop[i]]])
        i = stop[i]
    return out


#: What \s matches in the tiktoken library (the White_Space property); the regex
#: module also counts 0x1c to 0x1f.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ASCII_SPACES = tuple("\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
_ODD_SPACES = _ASCII_SPACES + tuple("\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") + tuple(map(chr, range(0x2000, 0x200B)))


class Codec:
    """Encodes texts to uint32 bytes and decodes them, with a memo of pre-tokens and pieces."""

    def __init__(self, tokens: list[bytes], pattern: str, table: PerfectHash, table_ids: list[int]):
        import regex

        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens) if t}
        self.table, self.table_ids = table, table_ids
        spaced = pattern.replace(r"[^\s", "[^" + _SPACE).replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
        self.split = regex.compile(spaced).findall
        self.memo = Memo()

    def _learn(self, words: list[str]) -> None:
        keys = [w.encode() for w in words]
        for w, key, f in zip(words, keys, self.table.find(keys).tolist()):
            i = self.table_ids[f]
            ids = [i] if self.tokens[i] == key else merge_bytes(key, self.ranks)
            self.memo.keep(w, struct.pack(f"<{len(ids)}I", *ids))

    def encode(self, texts: list[str]) -> list[bytes]:
        """A text in which white space is single spaces and line ends, no line end
        before a space, splits at its spaces: no pre-token reaches across one, and
        a space belongs to what follows it. Other texts are split as they are. A piece
        that is one pre-token is in the memo once."""
        memo = self.memo
        memo.turn()
        split, pieces, words = [], set(), set()
        for t in texts:
            if "  " in t or "\n " in t or "\0" in t or any(c in t for c in (_ASCII_SPACES if t.isascii() else _ODD_SPACES)):
                parts = self.split(t)
                words.update(parts)
            else:
                parts = t.replace(" ", "\0 ").split("\0")
                pieces.update(parts)
            split.append(parts)
        whole, parted = set(), []
        for p in memo.unknown(pieces):
            if len(s := self.split(p)) == 1:
                whole.add(p)
            else:
                parted.append((p, s))
                words.update(s)
        whole.update(memo.unknown(words))
        self._learn([*whole])
        known = memo.young
        for p, s in parted:
            memo.keep(p, b"".join([known[w] for w in s]))
        return [b"".join([known[p] for p in s]) for s in split]

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def bpe_roundtrip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes every whole text of docs and decodes the ids again.

    Returns per row: doc_id, n_tokens, ids_sha256 (of the ids as little-endian
    uint32), decoded_sha256 (of the decoded bytes); with keep_ids also ids
    (array<int>) and decoded (binary). A null text counts as empty and has no
    tokens. A null or repeated id is carried through; rows are independent, so
    there are no ties. An empty table gives no rows. Other columns are ignored.
    Each row stays in its task: no shuffle.
    """
    tokens = load_ranks(ranks_path)
    ids = [i for i, t in enumerate(tokens) if t]
    shared = docs.sparkSession.sparkContext.broadcast((tokens, pattern, PerfectHash([tokens[i] for i in ids]), ids))  # a vocabulary, of fixed size
    name = "bpe:" + hashlib.sha256(ranks_path.encode() + pattern.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store(name)
        if "codec" not in store:
            store["codec"] = Codec(*shared.value)
        codec = store["codec"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = codec.encode([t or "" for t in part.column(1).to_pylist()])
                back = [codec.decode(g) for g in got]
                columns = [part.column(0), pa.array([len(g) // 4 for g in got], pa.int64()), pa.array([hashlib.sha256(g).hexdigest() for g in got]), pa.array([hashlib.sha256(b).hexdigest() for b in back])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns += [pa.array([np.frombuffer(g, "<i4") for g in got], pa.list_(pa.int32())), pa.array(back, pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
