"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of whole texts come from numpy scans over their characters. From a bounded
sample of labelled rows, small boosted trees propose rules (each path from a root to a node is
a conjunction of thresholds), and a lasso logistic regression keeps few of them. The rules
that are left are compiled into column expressions over the statistics.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import worker_store
from .toxicity import slices

#: Thresholds of a statistic: at most so many quantiles of the sample.
BINS = 64
#: A rule holds for at least so many rows of the sample, and doesn't hold for as many.
LEAST_ROWS = 8


@dataclass(frozen=True)
class Rule:
    """A conjunction: each statistic above (or at most at) its threshold."""

    conditions: tuple[tuple[str, bool, float], ...]  # (statistic, above, threshold)
    weight: float = 0.0

    def column(self, stats: dict[str, Column]) -> Column:
        tests = [stats[s] > v if above else stats[s] <= v for s, above, v in self.conditions]
        return reduce(Column.__and__, tests)

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        tests = [x[:, names.index(s)] > v if above else x[:, names.index(s)] <= v for s, above, v in self.conditions]
        return np.logical_and.reduce(tests)

    def __str__(self) -> str:
        return " and ".join(f"{s} {'>' if above else '<='} {v:.6g}" for s, above, v in self.conditions)


@dataclass
class QualityModel:
    bias: float
    rules: list[Rule] = field(default_factory=list)

    def score(self, stats: dict[str, Column]) -> Column:
        """The chance of label 1 as a column over columns of statistics."""
        total = reduce(Column.__add__, [F.when(r.column(stats), r.weight).otherwise(0.0) for r in self.rules], F.lit(self.bias))
        return 1 / (1 + F.exp(-total))


STATISTICS = ("chars", "letters", "capitals", "digits", "symbols", "sign_runs", "lone_signs", "stops", "word_length", "distinct_words", "distinct_lines", "line_words")

# Kinds of a character, as bits.
_LETTER, _CAPITAL, _DIGIT, _SPACE, _BREAK, _SIGN, _RARE, _STOP = (1 << k for k in range(8))
#: Signs that prose is full of.
_PROSE = ".,;:'()-"


def _kinds() -> np.ndarray:
    """The kinds of all code points; a worker builds the table once."""
    store = worker_store("quality")
    if "kinds" not in store:
        of = {"Lu": _LETTER | _CAPITAL, "Nd": _DIGIT, "Zs": _SPACE, "Zl": _SPACE, "Zp": _SPACE, "Cc": _SIGN | _RARE}
        group = {"L": _LETTER, "M": 0, "N": 0}
        table = np.array([of.get(c, group.get(c[0], _SIGN | _RARE)) for c in map(unicodedata.category, map(chr, range(sys.maxunicode + 1)))], np.uint8)
        table[[9, 11, 12, 13]] = _SPACE
        table[10] = _SPACE | _BREAK
        table[[ord(c) for c in _PROSE]] = _SIGN
        table[[ord(c) for c in ".?"]] |= _STOP
        store["kinds"] = table
    return store["kinds"]


def _segments(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of an array of booleans begin and end."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _distinct(points: np.ndarray, first: np.ndarray, last: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many different segments each of n texts has (by 64-bit hashes)."""
    if not len(first):
        return np.zeros(n)
    size = last - first
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
    h = np.add.reduceat((points[np.repeat(first, size) + at].astype(np.uint64) + np.uint64(1)) * power[at], np.cumsum(size) - size)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
    return np.bincount(owner[new], minlength=n).astype(float)


def statistics(texts: list[str | None]) -> np.ndarray:
    """The STATISTICS of whole texts, a row each; a null text counts as empty, for which
    all are 0. Words are runs without white space, lines what line feeds part."""
    n = len(texts)
    lengths = np.array([len(t or "") for t in texts], np.int64)
    # Texts are parted by two blank lines, so no run reaches from one into the next.
    joined = "\n\n".join(["", *[t or "" for t in texts], ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[points]
    start = np.cumsum(lengths + 2) - lengths
    end = start + lengths

    def count(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask)])
        return (upto[end] - upto[start]).astype(float)

    has = lambda bit: (kind & bit) != 0
    space, sign, letter = has(_SPACE), has(_SIGN), has(_LETTER)
    before, after = (lambda m: np.concatenate([[False], m[:-1]])), (lambda m: np.concatenate([m[1:], [False]]))
    first, last = _segments(~space)
    owner = np.searchsorted(end, first, side="right")
    words = np.bincount(owner, minlength=n).astype(float)
    a, b = _segments(~has(_BREAK))
    upto = np.searchsorted(first, b) - np.searchsorted(first, a)  # words that begin in the line
    a, b = a[upto > 0], b[upto > 0]
    line_owner = np.searchsorted(end, a, side="right")
    lines = np.bincount(line_owner, minlength=n).astype(float)
    share = lambda x, y: np.divide(x, y, out=np.zeros(n), where=y > 0)
    letters = count(letter)
    columns = {
        "chars": np.log1p(lengths),
        "letters": share(letters, lengths.astype(float)),
        "capitals": share(count(has(_CAPITAL)), letters),
        "digits": share(count(has(_DIGIT)), lengths.astype(float)),
        "symbols": share(count(has(_RARE)), words),
        "sign_runs": share(count(sign & (before(sign) | after(sign))), words),
        "lone_signs": share(count(sign & before(space) & after(space)), words),
        "stops": share(count(has(_STOP) & before(letter) & after(space)), words),
        "word_length": share(letters, words),
        "distinct_words": share(_distinct(points, first, last, owner, n), words),
        "distinct_lines": share(_distinct(points, a, b, line_owner, n), lines),
        "line_words": share(words, lines),
    }
    return np.stack([columns[s] for s in STATISTICS], 1)


def with_statistics(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, and other plain columns) with the statistics instead of the text."""
    kept = [c for c in rows.columns if c != "text"]
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(at).fill_null("")):
                x = statistics(texts.to_pylist())
                old = [batch.column(batch.schema.get_field_index(c)).slice(first, len(x)) for c in kept]
                yield pa.RecordBatch.from_arrays([*old, *[pa.array(v) for v in x.T]], names=[*kept, *STATISTICS])

    schema = StructType([rows.schema[c] for c in kept] + [StructField(s, DoubleType()) for s in STATISTICS])
    return rows.mapInArrow(run, schema)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _grow(codes: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list) -> np.ndarray:
    """Grows a tree on rows by Newton gains; appends the path to each node (feature,
    above, bin) to out and returns the values of all samples that pass through."""
    value = np.zeros(len(g))
    value[rows] = -g[rows].sum() / (h[rows].sum() + 1.0)
    if depth == 0 or len(rows) < 2 * LEAST_ROWS:
        return value
    best = (1e-6, -1, -1)
    total_g, total_h, n = g[rows].sum(), h[rows].sum(), len(rows)
    for j in range(codes.shape[1]):
        c = codes[rows, j]
        left_g, left_h, left_n = (np.cumsum(np.bincount(c, w, minlength=BINS + 1)) for w in (g[rows], h[rows], None))
        gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
        gain[(left_n < LEAST_ROWS) | (n - left_n < LEAST_ROWS)] = 0
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), j, k)
    _, j, k = best
    if j < 0:
        return value
    above = codes[rows, j] > k
    for side in (False, True):
        p = (*path, (j, side, k))
        out.append(p)
        part = rows[above == side]
        value[part] = _grow(codes, g, h, part, depth - 1, p, out)[part]
    return value


def tree_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, rate: float = 0.2, seed: int = 0) -> list[Rule]:
    """Different rules from the paths of boosted trees, each grown on half the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    prior = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    z = np.full(len(y), np.log(prior / (1 - prior)))
    paths: list[tuple] = []
    for _ in range(trees):
        p = _sigmoid(z)
        half = np.flatnonzero(rng.random(len(y)) < 0.5)
        found: list[tuple] = []
        _grow(codes, weight * (p - y), weight * p * (1 - p), half, depth, (), found)
        paths += found
        # All rows step, also those that the tree didn't see.
        value = np.zeros(len(y))
        leaves = [f for f in found if not any(len(o) > len(f) and o[: len(f)] == f for o in found)]
        for f in leaves:
            at = np.logical_and.reduce([(codes[:, j] > k) == side for j, side, k in f])
            value[at] = -(weight * (p - y))[at].sum() / ((weight * p * (1 - p))[at].sum() + 1.0)
        z += rate * value
    rules = {}
    for f in paths:
        # Of several thresholds of a statistic in one direction the sharpest stands.
        sharp: dict[tuple[int, bool], int] = {}
        for j, side, k in f:
            sharp[j, side] = (max if side else min)(sharp.get((j, side), k), k)
        if all(k < len(cuts[j]) for (j, _), k in sharp.items()):
            rule = Rule(tuple((names[j], side, float(cuts[j][k])) for (j, side), k in sorted(sharp.items())))
            rules[rule] = None
    return list(rules)


def lasso(m: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Weighted logistic regression with an L1 penalty by accelerated proximal steps;
    the intercept isn't penalised."""
    a = np.concatenate([np.ones((len(m), 1)), m], 1)
    total = weight.sum()
    # A bound of the largest eigenvalue by power iteration, with some room.
    v = np.ones(a.shape[1])
    for _ in range(30):
        v = a.T @ (weight * (a @ v))
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    step = 4 * total / (1.1 * norm)
    w = np.zeros(a.shape[1])
    u, t = w.copy(), 1.0
    for _ in range(steps):
        g = a.T @ (weight * (_sigmoid(a @ u) - y)) / total
        new = u - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return float(w[0]), w[1:]


def _loss(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum() / weight.sum())


def fit_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray, names: list[str], penalties: tuple[float, ...] = (0.01, 0.003, 0.001, 0.0003, 0.0001), seed: int = 0) -> QualityModel:
    """Rules and weights for a matrix of statistics; the penalty is the one with the least
    loss on a fifth of the rows that the others don't see."""
    fold = np.random.default_rng(seed + 1).random(len(y)) < 0.2
    if min(y[fold].sum(), (1 - y[fold]).sum(), y[~fold].sum(), (1 - y[~fold]).sum()) > 0:
        rules = tree_rules(x[~fold], y[~fold], weight[~fold], names, seed=seed)
        m = np.stack([r.holds(x, names) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
        losses = []
        for p in penalties:
            b, w = lasso(m[~fold], y[~fold], weight[~fold], p)
            losses.append(_loss(b + m[fold] @ w, y[fold], weight[fold]))
        penalty = penalties[int(np.argmin(losses))]
    else:
        penalty = penalties[len(penalties) // 2]
    rules = tree_rules(x, y, weight, names, seed=seed)
    m = np.stack([r.holds(x, names) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    bias, w = lasso(m, y, weight, penalty)
    return QualityModel(bias, [Rule(r.conditions, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6])


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_per_class: int = 4000, seed: int = 0) -> QualityModel | None:
    """Learns from labelled documents that are not held out: at most sample_per_class of
    either label, by a hash of the id; weights of rows keep the labels' true shares. Only
    statistics of the sample, not texts, come to the driver. A document with several
    label rows has the smaller label, one id with several texts the least of them; null
    labels count for nothing. None if there are no labelled texts of both kinds."""
    spark = docs.sparkSession
    own = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out("doc_id"))
    own = own.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in own.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return None
    # Of the least hashes of either label little more than is wanted (ten standard
    # deviations) reaches the sort, however many partitions there are.
    enough = sample_per_class + 10 * sample_per_class**0.5 + 50
    drawn = []
    for c, n in sorted(counts.items()):
        h = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40))
        few = own.where((F.col("quality") == c) & (h <= int((1 << 40) * min(1.0, enough / n))))
        drawn += few.orderBy(h, "doc_id").limit(sample_per_class).collect()
    ids = spark.createDataFrame(drawn, "doc_id long, quality int")  # at most 2 * sample_per_class rows
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    sample = sample.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = with_statistics(sample).collect()
    got.sort(key=lambda r: r["doc_id"])
    y = np.array([r["quality"] for r in got], float)
    if not 0 < y.sum() < len(y):
        return None
    x = np.array([[r[s] for s in STATISTICS] for r in got], float)
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (len(y) - y.sum()))
    return fit_rules(x, y, weight / weight.mean(), list(STATISTICS), seed=seed)


def score_quality(docs: DataFrame, model: QualityModel | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, n_rules) per row of docs: the chance of label 1, whether it is
    at least threshold, and how many rules hold.

    A null text counts as empty; empty texts are scored by the statistics of an empty
    text. A text of any length is read whole. Null and repeated ids are carried through,
    equal texts get equal scores, and an empty table gives no rows. Without a model every
    score is 0. Other columns, whatever their names, are ignored. No shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0).alias("n_rules"))
    rows = with_statistics(rows)
    names = {s: F.col(s) for s in STATISTICS}
    held = reduce(Column.__add__, [r.column(names).cast("int") for r in model.rules], F.lit(0))
    rows = rows.select("doc_id", model.score(names).alias("score"), held.alias("n_rules"))
    return rows.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_rules")


def rate_quality(docs: DataFrame, labels: DataFrame, sample_per_class: int = 4000) -> DataFrame:
    """Fits on docs and labels (doc_id, quality), then scores all docs:
    (doc_id, held_out, score, predicted, n_rules)."""
    out = score_quality(docs, fit_quality(docs, labels, sample_per_class))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "n_rules")
