"""Column functions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, once


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def standardised(a: Column) -> Column:
    """Zero mean, unit norm; all zero for a constant array."""
    centred = once(mean(a), lambda m: F.transform(a, lambda x: x.cast("double") - m))
    scaled = lambda x: F.transform(x["c"], lambda v: F.when(x["norm"] > 0, v / x["norm"]).otherwise(0.0))
    return once(centred, lambda c: bound(scaled, c=c, norm=F.sqrt(total(F.transform(c, lambda v: v * v)))))


def product(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def argmax(a: Column) -> Column:
    """The index of the first largest value, from 0."""
    return F.array_position(a, F.array_max(a)) - 1


def chosen_probability(logits: Column) -> Column:
    """Softmax probability of the largest logit."""
    return once(F.array_max(logits), lambda top: 1 / total(F.transform(logits, lambda x: F.exp(x.cast("double") - top))))


def confidence(probabilities: Column) -> Column:
    """(least, mean): the least probability of a reading and the geometric mean."""
    logs = F.transform(probabilities, lambda p: F.ln(p.cast("double")))
    return F.struct(F.array_min(probabilities).alias("least"), F.exp(mean(logs)).alias("mean"))


def middle(a: Column) -> Column:
    """The value at index floor(n / 2) of the sorted array."""
    return F.get(F.array_sort(a), F.floor(F.size(a) / 2).cast("int"))


def shrink_to(width: Column, height: Column, budget: int) -> Column:
    """The factor by which a picture of width x height fits a budget of pixels."""
    return F.least(F.lit(1.0), F.sqrt(budget / (width * height)))


def trimmed_mean(a: Column, times: float = 2.5, least: int = 4) -> Column:
    """The mean of the values up to `times` the middle one; null for fewer than `least`."""
    kept = once(middle(a) * times, lambda top: F.filter(a, lambda x: x <= top))
    return F.when(F.size(a) >= least, once(kept, mean))
