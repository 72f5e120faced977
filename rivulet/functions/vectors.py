"""Vectors, matrices (row-major arrays), rectangles and small integer mathematics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / F.nullif(length(a), F.lit(0.0)))


def mean_abs_error(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))) / F.size(a)


def mean_sq_error(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))) / F.size(a)


def mat_mul(a: Column, b: Column, n: int) -> Column:
    """Product of two n x n matrices."""
    cell = lambda i, j: sum((F.get(a, i * n + k).cast("double") * F.get(b, k * n + j).cast("double") for k in range(1, n)), F.get(a, i * n).cast("double") * F.get(b, j).cast("double"))
    return F.array(*[cell(i, j) for i in range(n) for j in range(n)])


def mat_apply(a: Column, v: Column, n: int) -> Column:
    return F.array(*[dot(F.slice(a, i * n + 1, n), v) for i in range(n)])


def inverse_2x3(m: Column) -> Column:
    """Inverse of the affine map [a b tx; c d ty]; null if it has none."""
    a, b, tx, c, d, ty = (F.get(m, i).cast("double") for i in range(6))
    det = F.nullif(a * d - b * c, F.lit(0.0))
    return F.array(d / det, -b / det, (b * ty - d * tx) / det, -c / det, a / det, (c * tx - a * ty) / det)


def rect_union(a: Column, b: Column) -> Column:
    """Smallest rectangle struct(x, y, w, h) around both."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return F.struct(x.alias("x"), y.alias("y"), (F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x).alias("w"), (F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y).alias("h"))


def rect_intersection(a: Column, b: Column) -> Column:
    """Common part; null if there is none."""
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    w, h = F.least(a["x"] + a["w"], b["x"] + b["w"]) - x, F.least(a["y"] + a["h"], b["y"] + b["h"]) - y
    return F.when((w > 0) & (h > 0), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def rect_overlaps(a: Column, b: Column) -> Column:
    return rect_intersection(a, b).isNotNull()


def rect_contains(a: Column, b: Column) -> Column:
    return (a["x"] <= b["x"]) & (a["y"] <= b["y"]) & (a["x"] + a["w"] >= b["x"] + b["w"]) & (a["y"] + a["h"] >= b["y"] + b["h"])


def bit_size(x: Column) -> Column:
    """Bits that x needs; 0 for 0."""
    return F.when(x > 0, F.length(F.bin(x))).otherwise(0)


def next_power_of_two(x: Column) -> Column:
    """The smallest power of two that is x or more."""
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.conv(F.rpad(F.lit("1"), F.length(F.bin(x - 1)) + 1, F.lit("0")), 2, 10).cast("long"))


def mul_div(a: Column, b: Column, c: Column) -> Column:
    """a * b / c without 64-bit overflow, truncated."""
    wide = a.cast("decimal(38,0)") * b.cast("decimal(38,0)")
    c = F.nullif(c.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return ((wide - wide % c) / c).cast("long")


def colour_lerp(a: Column, b: Column, t: float) -> Column:
    """ARGB numbers mixed component by component."""
    part = lambda x, s: F.shiftrightunsigned(x, s).bitwiseAND(255)
    mixed = lambda s: F.shiftleft(F.floor(part(a, s) + (part(b, s) - part(a, s)) * t).cast("long"), s)
    return mixed(24).bitwiseOR(mixed(16)).bitwiseOR(mixed(8)).bitwiseOR(mixed(0))
