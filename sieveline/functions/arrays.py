"""Vector arithmetic on array columns, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def unit(v: Column, floor: float = 1e-12) -> Column:
    """v / (|v| + floor), the norm worked out once."""
    return F.element_at(F.transform(F.array(norm(v) + floor), lambda n: F.transform(v, lambda x: x / n)), 1)


def softmax(v: Column) -> Column:
    """Softmax shifted by the maximum."""
    exp = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.element_at(F.transform(F.array(exp), lambda e: F.transform(e, lambda x: x / total(e))), 1)


def entropy(p: Column, classes: int | None = None, floor: float = 1e-12) -> Column:
    """-sum p ln p with p clamped from below; divided by ln(classes) if given."""
    h = -total(F.transform(p, lambda x: x * F.ln(F.greatest(x, F.lit(floor)))))
    return h / F.ln(F.lit(float(classes))) if classes else h


def margin(p: Column) -> Column:
    """Greatest minus second greatest."""
    s = F.sort_array(p, asc=False)
    return F.get(s, F.lit(0)) - F.get(s, F.lit(1))


def argmax(p: Column) -> Column:
    """Zero-based index of the first maximum."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def median(v: Column) -> Column:
    """Median of an array, the mean of the middle two for even lengths."""
    s, n = F.sort_array(v), F.size(v)
    lo, hi = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return (F.get(s, lo) + F.get(s, hi)) / 2


def pack_bits(flags: Column) -> Column:
    """Booleans, least significant first, as a 64-bit long."""
    bits = F.transform(flags, lambda b, i: F.when(b, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def vector_mean(v: Column, size: int) -> Column:
    """Element-wise mean of an array column of fixed size, as an aggregate."""
    return F.array(*[F.avg(F.get(v, F.lit(i)).cast("double")) for i in range(size)])
