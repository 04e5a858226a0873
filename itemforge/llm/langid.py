"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a logistic classifier over
hashed byte n-grams tells the languages with a 1 from those with a 0. A text gets
the language whose codeword has the least total logistic loss under the margins
of the bits (loss-weighted decoding); a text whose two nearest codewords are
nearly as far is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import worker_store

DIM_BITS = 12
DIM = 1 << DIM_BITS
#: Bytes of a text that are hashed at a time.
STEP = 1 << 20
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # DIM x bits
    bias: np.ndarray
    scale: float  # of the losses, so that softmax of them is a calibrated score


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """A code of n rows. Up to 5 rows: the exhaustive code of all 2^(n-1) - 1 ways
    to part them; beyond, the best of 200 random codes by least distance."""
    if n <= 5:
        cols = [[1 if k == 0 or (m >> (k - 1)) & 1 else -1 for k in range(n)] for m in range(max(1, 2 ** (n - 1) - 1))]
        return np.array(cols, np.float32).T
    bits = int(np.ceil(10 * np.log2(n)))
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits)).astype(np.float32)
        code = code[:, np.abs(code.sum(0)) < n]
        apart = (code[:, None, :] != code[None]).sum(2)
        least = apart[~np.eye(n, dtype=bool)].min()
        if least > far:
            best, far = code, least
    return best


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte uni-, bi- and trigrams of the
    whole lower-cased text, read in pieces of STEP bytes."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(DIM, np.int64)
    for at in range(0, max(1, len(data)), STEP):
        b = data[at : at + STEP + 2].astype(np.uint32)
        own = min(STEP, len(data) - at)
        two = (b[:-1] << np.uint32(8)) | b[1:] | np.uint32(1 << 16)
        three = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:] | np.uint32(1 << 24)
        for code in (b[:own], two[:own], three[:own]):
            if len(code):
                counts += np.bincount((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIM_BITS), minlength=DIM)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _fit_bits(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-5):
    """Logistic regressions of all bits at once, by Adam over the whole sample."""
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    b = np.zeros(y.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        g = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / len(x)
        gw, gb = x.T @ g + decay * w, g.sum(0)
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        a, c = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / a) / (np.sqrt(v / c) + 1e-8)
        b -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return w, b


def losses(model: LanguageModel, x: np.ndarray) -> np.ndarray:
    """Texts x languages: the sum over bits of log(1 + exp(-bit * margin))."""
    f = x @ model.weights + model.bias
    return np.logaddexp(0, -f[:, None, :] * model.code[None]).sum(2)


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit_languages(docs: DataFrame, sample_rows: int = 2400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 0) -> LanguageModel:
    """Fits on labelled rows that are not held out: at most sample_rows of them,
    the same number for each language, chosen by a hash of the id. Their feature
    vectors are made in tasks; the driver gets sample_rows vectors of DIM floats."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((0, 1), np.float32), np.zeros((DIM, 1), np.float32), np.zeros(1, np.float32), 1.0)
    each = max(1, sample_rows // len(languages))
    share = F.create_map(*[F.lit(v) for lang in languages for v in (lang, min(1.0, 1.2 * each / counts[lang]))])
    h = F.xxhash64(F.lit(seed), "id")
    thinned = rows.where((F.pmod(h, F.lit(1 << 30)) / F.lit(float(1 << 30))) < share[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(h, "id", "text"))
    sample = thinned.withColumn("_r", rank).where(F.col("_r") <= each)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1)
            yield pa.RecordBatch.from_arrays([langs, pa.array([features(t).astype(np.float16).tobytes() for t in texts], pa.binary())], names=["lang", "x"])

    got = sample.select("text", "lang").mapInArrow(vectors, "lang string, x binary").collect()
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32)
    truth = np.array([languages.index(r["lang"]) for r in got])
    code = codewords(len(languages), seed)
    weights, bias = _fit_bits(x, code[truth])
    model = LanguageModel(languages, code, weights, bias, 1.0)
    if len(languages) > 1:  # the scale under which the sample is likeliest
        d = losses(model, x)
        best = min(np.geomspace(0.05, 2, 20), key=lambda s: -np.log(np.take_along_axis(_softmax(-s * d), truth[:, None], 1) + 1e-9).mean())
        model.scale = float(best)
    return model


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", ambiguous_below: float = 0.6, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, lang_second, ambiguous, *keep) per row of docs.

    lang_pred is `und` with score 0 where text is null or has no letter (or no
    language was learned). score is the softmax of the scaled losses. ambiguous:
    the score is below ambiguous_below. Equal losses: the language first in order.
    Each row stays in its task; null and repeated ids are carried through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x bits floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("")  # a worker that encoded tokens before needs its memos no more
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                good = [k for k, t in enumerate(texts) if t and m.languages and has_letter(t)]
                first, second, score = [UNKNOWN] * len(texts), [None] * len(texts), [0.0] * len(texts)
                if good:
                    d = losses(m, np.stack([features(texts[k]) for k in good]))
                    p = _softmax(-m.scale * d)
                    order = np.argsort(d, 1, kind="stable")
                    for row, k in enumerate(good):
                        first[k], score[k] = m.languages[order[row, 0]], float(min(1.0, p[row, order[row, 0]]))
                        second[k] = m.languages[order[row, 1]] if len(m.languages) > 1 else None
                columns = [part.column(0), pa.array(first, pa.string()), pa.array(score, pa.float64()), pa.array(second, pa.string()), pa.array([s < ambiguous_below for s in score])]
                yield pa.RecordBatch.from_arrays(columns + [part.column(1 + c) for c in range(1, 1 + len(keep))], names=names)

    names = ["doc_id", "lang_pred", "score", "lang_second", "ambiguous", *[f"k{i}" for i in range(len(keep))]]
    kinds = dict(docs.select(*keep).dtypes) if keep else {}
    schema = "doc_id long, lang_pred string, score double, lang_second string, ambiguous boolean" + "".join(f", k{i} {kinds[c]}" for i, c in enumerate(keep))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    out = rows.mapInArrow(run, schema)
    return out.withColumnsRenamed({f"k{i}": f"kept_{c}" for i, c in enumerate(keep)})


def identify_languages(docs: DataFrame, sample_rows: int = 2400) -> DataFrame:
    """Fits on docs (doc_id, text, lang) and predicts for all of them:
    (doc_id, held_out, lang_pred, score, lang_second, ambiguous)."""
    out = predict_languages(docs, fit_languages(docs, sample_rows))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "lang_second", "ambiguous")


def keep_known_languages(docs: DataFrame, sample_rows: int = 2400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are in a learned language, unchanged: texts that are null
    or have no letter go. Without labelled rows to learn from all texts with a letter stay."""
    model = fit_languages(docs, sample_rows, id_col, text_col, lang_col)
    found = predict_languages(docs, model, id_col, text_col, keep=tuple(docs.columns))
    kept = found if not model.languages else found.where(F.col("lang_pred") != UNKNOWN)
    if not model.languages:
        kept = kept.where(F.col(f"kept_{text_col}").rlike(r"(?U)\p{IsAlphabetic}"))
    return kept.select(*[F.col(f"kept_{c}").alias(c) for c in docs.columns])
