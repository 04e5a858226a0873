"""Column functions on transformations (2 x 3 matrices, structs of a to f) and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

MATRIX = "struct<a: double, b: double, c: double, d: double, e: double, f: double>"
BOX = "struct<x0: double, y0: double, x1: double, y1: double>"


def matrix(*values: Column | float) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(n) for n, v in zip("abcdef", values, strict=True)])


def placed(m: Column, x: Column | float, y: Column | float) -> Column:
    """Where a point comes to lie: (x, y)."""
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def combined(outer: Column, inner: Column) -> Column:
    """The transformation that applies inner, then outer."""
    turned = [outer[p] * inner[q] + outer[r] * inner[s] for q, s in (("a", "b"), ("c", "d")) for p, r in (("a", "c"), ("b", "d"))]
    moved = placed(outer, inner["e"], inner["f"])
    return matrix(*turned, moved["x"], moved["y"])


def box(x0: Column | float, y0: Column | float, x1: Column | float, y1: Column | float) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])


def placed_box(m: Column, b: Column) -> Column:
    """The upright box around a transformed one."""
    corners = lambda v: [placed(v["m"], v["b"][x], v["b"][y]) for x in ("x0", "x1") for y in ("y0", "y1")]
    around = lambda v: box(F.least(*[p["x"] for p in corners(v)]), F.least(*[p["y"] for p in corners(v)]), F.greatest(*[p["x"] for p in corners(v)]), F.greatest(*[p["y"] for p in corners(v)]))
    return bound(around, m=m, b=b)


def shared_box(a: Column, b: Column) -> Column:
    """What two boxes share (it may be turned inside out); the other where one is null."""
    both = box(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)
