"""Toxic spans by a linear-chain conditional random field.

Each line of a text is a chain of white-space tokens with the states clean and
toxic. Token labels for training come from document labels: in a toxic document,
the tokens whose word or stem is far likelier in toxic documents are toxic. The
field learns hashed features of the token (word, stems, ending) and of its
neighbours, and the transitions. Forward-backward marginals of all tokens give
the offending spans, and their aggregates give the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

DIM_BITS = 16
DIM = 1 << DIM_BITS
#: Bytes of text whose chains are handled together; a longer text is handled alone.
SLICE = 2_000_000
#: A stem is the first so many letters of a longer word.
STEMS = (4, 5, 6)
_POWER = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))
_EDGES = "\"'“”‘’«».,;:!?¡¿()[]{}<>*_-|…"


@dataclass
class ToxicModel:
    weights: np.ndarray  # DIM: of the hashed features, for toxic against clean
    bias: float
    start: float  # log odds of toxic at the start of a chain
    trans: np.ndarray  # 2 x 2 log potentials, from row to column; 1 is toxic
    doc: np.ndarray  # intercept and weights of the document's aggregates


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (h >> np.uint64(64 - DIM_BITS)).astype(np.int64)


def _hashes(words: pa.Array) -> np.ndarray:
    """Polynomial hashes of the bytes of each word, as differences of running sums."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    size = np.diff(ends)
    at = np.arange(len(raw)) - np.repeat(ends[:-1] - ends[0], size)
    letters = (raw.astype(np.uint64) + np.uint64(1)) * _POWER[at % len(_POWER)]
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters, dtype=np.uint64)])
    return np.diff(upto[ends - ends[0]])


def normal(chunk: str) -> str:
    return chunk.strip(_EDGES).lower()


def features(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: the features of its word (itself, ending, stems; DIM where it has no
    such stem), one column each, and the features that it gives the token after it and
    the token before it."""
    words = pc.utf8_lower(pc.utf8_trim(chunks, characters=_EDGES))
    whole, letters = _hashes(words), pc.utf8_length(words).to_numpy()
    own = [_mix(whole, 1), _mix(_hashes(pc.utf8_slice_codeunits(words, -3)), 2)]
    own += [np.where(letters > n, _mix(_hashes(pc.utf8_slice_codeunits(words, 0, n)), n), DIM) for n in STEMS]
    return np.stack(own, 1), _mix(whole, 11), _mix(whole, 12)


def marginals(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, start: float, trans: np.ndarray) -> np.ndarray:
    """P(toxic) of each token by forward-backward over many chains at once.

    e holds the chains' log odds one chain after the other. With two states a
    message is one number, its odds; step t handles token t of all chains that
    are so long, so the steps are as many as the longest chain has tokens.
    """
    if not len(e):
        return np.zeros(0)
    order = np.argsort(-lengths, kind="stable")
    s, n = starts[order], lengths[order]
    x = np.exp(np.clip(e, -40, 40))
    (oo, ot), (to, tt) = np.exp(trans)
    longest = int(n[0])
    alive = np.searchsorted(-n, -np.arange(longest), side="left")  # chains with more than t tokens
    forward = np.empty(len(e))
    forward[s[: alive[0]]] = r = x[s[: alive[0]]] * np.exp(start)
    for t in range(1, longest):
        at = s[: alive[t]] + t
        r = r[: alive[t]]
        r = np.clip(x[at] * (tt * r + ot) / (to * r + oo), 1e-30, 1e30)
        forward[at] = r
    backward = np.ones(len(e))
    b = np.ones(0)
    for t in range(longest - 1, 0, -1):
        b = np.concatenate([b, np.ones(alive[t] - len(b))])
        at = s[: alive[t]] + t
        z = x[at] * b
        b = np.clip((tt * z + to) / (ot * z + oo), 1e-30, 1e30)
        backward[at - 1] = b
    odds = forward * backward
    return odds / (1 + odds)


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows): consecutive parts of texts of about `size` bytes."""
    part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    cuts = [*np.flatnonzero(np.diff(part, prepend=-1)), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        yield int(a), texts.slice(a, b - a)


@dataclass
class Tokens:
    """The white-space tokens of many texts, without empty ones, one text after the other."""

    words: pa.DictionaryArray
    chains: np.ndarray  # lengths of the lines that have tokens
    ends: np.ndarray  # of each text: the tokens up to its end

    def of(self, text: int) -> list[str]:
        a = self.ends[text - 1] if text else 0
        return self.words.slice(a, self.ends[text] - a).to_pylist()


def tokens(texts: pa.Array) -> Tokens:
    lines = pc.split_pattern(texts, "\n")
    chunks = pc.utf8_split_whitespace(lines.flatten())
    line_ends, chunk_ends = lines.offsets.to_numpy(), chunks.offsets.to_numpy()
    line_ends, chunk_ends = line_ends - line_ends[0], chunk_ends - chunk_ends[0]
    flat = chunks.flatten()
    real = pc.binary_length(flat).to_numpy() > 0
    upto = np.concatenate([[0], np.cumsum(real)])[chunk_ends]  # real tokens before each line
    lengths = np.diff(upto)
    return Tokens(flat.filter(pa.array(real)).dictionary_encode(), lengths[lengths > 0], upto[line_ends[1:]])


def tag(t: Tokens, model: ToxicModel) -> list[np.ndarray]:
    """The marginals of the tokens of each text, whose chains are its lines."""
    own, before, after = features(t.words.dictionary)
    w = np.append(model.weights, np.float32(0))
    at = t.words.indices.to_numpy()
    e = (w[own].sum(1, dtype=np.float64) + model.bias)[at]
    starts = np.cumsum(t.chains) - t.chains
    inner = np.ones(len(e), bool)
    inner[starts] = False  # has a word before it in its chain
    k = np.flatnonzero(inner)
    e[k] += w[before[at[k - 1]]]
    e[k - 1] += w[after[at[k]]]
    return np.split(marginals(e, starts, t.chains, model.start, model.trans), t.ends[:-1])


def aggregates(p: np.ndarray) -> np.ndarray:
    """Expected number of toxic tokens (log), the largest marginal, and the chance
    that any token is toxic."""
    if not len(p):
        return np.zeros(3)
    q = np.clip(p, 0, 1 - 1e-9)
    return np.array([np.log1p(q.sum()), q.max(), -np.expm1(np.log1p(-q).sum())])


def spans(text: str, words: list[str], p: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
    """Code point offsets of the runs of tokens with marginals of at least `least`; a
    run ends with its line. words are the text's tokens in order."""
    out: list[tuple[int, int]] = []
    last, at = -2, 0
    for k, w in enumerate(words):
        start = text.index(w, at)
        at = start + len(w)
        if p[k] >= least:
            if last == k - 1 and "\n" not in text[out[-1][1] : start]:
                out[-1] = (out[-1][0], at)
            else:
                out.append((start, at))
            last = k
    return out


def _fit_field(chains: list[tuple[list[str], list[int]]], steps: int = 60, rate: float = 0.15, decay: float = 1e-4) -> tuple[np.ndarray, float, float, np.ndarray]:
    """Maximum likelihood by Adam: observed less expected features."""
    words = pa.array([w for ws, _ in chains for w in ws]).dictionary_encode()
    y = np.array([v for _, ys in chains for v in ys], np.float64)
    lengths = np.array([len(ws) for ws, _ in chains])
    starts = np.cumsum(lengths) - lengths
    own, before, after = features(words.dictionary)
    place = words.indices.to_numpy()
    inner = np.ones(len(words), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    tok, column = np.nonzero(own[place] < DIM)
    feat = np.concatenate([own[place[tok], column], before[place[at - 1]], after[place[at]]])
    tok = np.concatenate([tok, at, at - 1])
    theta = np.zeros(DIM + 6)  # features, bias, start, transitions
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    observed = np.bincount((2 * y[at - 1] + y[at]).astype(int), minlength=4)
    for t in range(1, steps + 1):
        w, bias, start, trans = theta[:DIM], theta[DIM], theta[DIM + 1], theta[DIM + 2 :].reshape(2, 2)
        e = np.bincount(tok, w[feat], minlength=len(words)) + bias
        p = marginals(e, starts, lengths, start, trans)
        # Pair marginals of neighbours k-1 and k, from their messages towards each other.
        pair = _pairs(e, starts, lengths, start, trans, at)
        d = y - p
        g = np.concatenate([np.bincount(feat, d[tok], minlength=DIM), [d.sum(), d[starts].sum()], observed - pair.sum(0)]) / len(words)
        g[:DIM] -= decay * w / len(chains)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        theta += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return theta[:DIM].astype(np.float32), float(theta[DIM]), float(theta[DIM + 1]), theta[DIM + 2 :].reshape(2, 2)


def _pairs(e, starts, lengths, start, trans, at) -> np.ndarray:
    """Marginals (clean-clean, clean-toxic, toxic-clean, toxic-toxic) of the tokens
    at[i] - 1 and at[i], by the same messages as in marginals()."""
    order = np.argsort(-lengths, kind="stable")
    s, n = starts[order], lengths[order]
    x = np.exp(np.clip(e, -40, 40))
    a = np.exp(trans)
    (oo, ot), (to, tt) = a
    longest = int(n[0]) if len(n) else 0
    alive = np.searchsorted(-n, -np.arange(longest), side="left")
    f, b = np.empty(len(e)), np.ones(len(e))
    f[s] = r = x[s] * np.exp(start)
    for t in range(1, longest):
        i = s[: alive[t]] + t
        r = r[: alive[t]]
        f[i] = r = np.clip(x[i] * (tt * r + ot) / (to * r + oo), 1e-30, 1e30)
    z = np.ones(0)
    for t in range(longest - 1, 0, -1):
        z = np.concatenate([z, np.ones(alive[t] - len(z))])
        i = s[: alive[t]] + t
        y = x[i] * z
        b[i - 1] = z = np.clip((tt * y + to) / (ot * y + oo), 1e-30, 1e30)
    left, right = f[at - 1], x[at] * b[at]
    q = np.stack([np.full(len(at), oo), ot * right, to * left, tt * left * right], 1)
    return q / q.sum(1, keepdims=True)


def _fit_doc(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the first is the intercept."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
    return w


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_per_class: int = 4000, max_chains: int = 12000, seed: int = 0, chain_tokens: int = 200, max_signs: int | None = None, min_support: int = 6) -> ToxicModel | None:
    """Fits on labelled documents that are not held out: at most sample_per_class
    of either label, by a hash of the id, and at most max_chains chains of their
    lines. Longer lines are cut into consecutive chains of chain_tokens tokens. A sign
    of toxicity stands behind at least min_support different words in toxic documents;
    with max_signs only so many signs are used. A document with several label rows has
    the larger label, one id with several texts the least of them, one text with several
    ids the label of the least id; null labels count for nothing. None if there are no
    labelled texts of both kinds; texts of both kinds without any token are an error.

    The sample is written once, so that all that is learned is learned from the same
    rows. Only its ids are broadcast; words are counted in Spark.
    """
    spark = docs.sparkSession
    own = labels.select(F.col("doc_id"), F.col("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
    own = own.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    # Of the least hashes of either label little more than is wanted (ten standard
    # deviations) reaches the sort, however many partitions there are.
    enough = sample_per_class + 10 * sample_per_class**0.5 + 50
    drawn = []
    for c, n in counts.items():
        h = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40))
        few = own.where((F.col("toxic") == c) & (h <= int((1 << 40) * min(1.0, enough / n))))
        drawn += few.orderBy(h, "doc_id").limit(sample_per_class).collect()
    ids = spark.createDataFrame(drawn, "doc_id long, toxic int")  # at most 2 * sample_per_class rows
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = sample.groupBy("text").agg(F.min(F.struct("doc_id", "toxic")).alias("d")).select("d.doc_id", "d.toxic", "text")
    sample = materialize(sample.repartition(spark.sparkContext.defaultParallelism, "doc_id"), "toxic-sample")
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return None
    # A word, or a stem of it, is a sign of toxicity if it stands behind far more
    # different words in toxic documents than in clean ones. (Copies of a document
    # repeat the words around it and so count once.)
    chunks = F.split("text", r"\s+")
    pairs = F.arrays_zip(chunks.alias("t"), F.concat(F.array(F.lit("")), F.slice(chunks, 1, F.greatest(F.size(chunks) - 1, F.lit(0)))).alias("before"))
    word = F.lower(F.regexp_replace("x.t", r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", ""))
    words = sample.select("toxic", F.explode(pairs).alias("x")).select("toxic", word.alias("w"), F.lower("x.before").alias("before")).where("w <> ''")
    stems = F.array(F.col("w"), *[F.when(F.length("w") > n, F.concat(F.lit(f"{n}:"), F.substring("w", 1, n))) for n in STEMS])
    units = words.distinct().select("toxic", "before", F.explode(stems).alias("u")).where("u is not null").distinct()
    seen = units.groupBy("u").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b = F.col("a") / float(totals[1]), (F.col("b") + 0.5) / float(totals[0])
    signs = seen.where((F.col("a") >= min_support) & (a > 12 * b)).orderBy(F.desc("a"), "u")
    signs = signs if max_signs is None else signs.limit(max_signs)
    signs = {r["u"] for r in signs.select("u").collect()}

    def toxic_word(w: str) -> bool:
        return w in signs or any(len(w) > n and f"{n}:{w[:n]}" in signs for n in STEMS)

    lines = sample.select("doc_id", "toxic", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    lines = lines.select("doc_id", "toxic", "k", F.array_remove(F.split("line", r"(?U)\s+"), "").alias("w")).where(F.size("w") > 0)
    firsts = F.sequence(F.lit(1), F.size("w"), F.lit(chain_tokens))
    pieces = F.transform(firsts, lambda i: F.array_join(F.slice("w", i, chain_tokens), " "))
    lines = lines.select("doc_id", "toxic", "k", F.posexplode(pieces).alias("piece", "line"))
    per = {1: 2 * max_chains // 3, 0: max_chains // 3}
    chains = []
    for c in (0, 1):
        for r in lines.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id", "k", "piece"), "doc_id", "k", "piece").limit(per[c]).select("line").collect():
            ws = r["line"].split()
            if ws:
                chains.append((ws, [int(c == 1 and toxic_word(normal(w))) for w in ws]))
    if not chains:
        raise ValueError("no token in the labelled texts to learn from")
    weights, bias, start, trans = _fit_field(chains)
    model = ToxicModel(weights, bias, start, trans, np.zeros(4))
    got = _aggregate_docs(sample.select("doc_id", "text"), model).join(F.broadcast(ids), "doc_id").collect()
    x = np.array([r["x"] for r in got])
    y = np.array([r["toxic"] for r in got], float)
    weight = np.where(y == 1, counts[1] / max(1, totals[1]), counts[0] / max(1, totals[0]))
    model.doc = _fit_doc(x, y, weight / weight.mean())
    return model


def _aggregate_docs(docs: DataFrame, model: ToxicModel) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1).fill_null("")):
                p = tag(tokens(texts), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(p)), pa.array([aggregates(x).tolist() for x in p], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id long, x array<double>")


def score_toxicity(docs: DataFrame, model: ToxicModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, n_spans, spans) per row of docs; spans are the
    offending token runs as start:end in code points, comma-joined.

    A null text counts as empty: it has no tokens and gets the score of a text
    without toxic tokens; a text of any length is scored whole, in one task. Null and
    repeated ids are carried through, equal texts get equal scores, and an empty table
    gives no rows. Without a model every score is 0. Other columns, whatever their names,
    are ignored. No shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0).cast("long").alias("n_spans"), F.lit("").alias("spans"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.doc
        for batch in batches:
            for at, texts in slices(batch.column(1).fill_null("")):
                t = tokens(texts)
                p = tag(t, shared.value)
                z = np.array([w[0] + aggregates(x) @ w[1:] for x in p])
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                found = [spans(texts[k].as_py(), t.of(k), x) if len(x) and x.max() >= 0.5 else [] for k, x in enumerate(p)]
                columns = [batch.column(0).slice(at, len(p)), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(f"{a}:{b}" for a, b in f) for f in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted", "n_spans", "spans"])

    return rows.mapInArrow(run, "doc_id long, score double, predicted int, n_spans long, spans string")


def detect_toxicity(docs: DataFrame, labels: DataFrame, sample_per_class: int = 4000) -> DataFrame:
    """Fits on docs and labels (doc_id, toxic), then scores all docs:
    (doc_id, held_out, score, predicted, n_spans, spans)."""
    out = score_toxicity(docs, fit_toxicity(docs, labels, sample_per_class))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "n_spans", "spans")
