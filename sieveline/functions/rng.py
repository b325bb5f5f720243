"""Deterministic pseudo-randomness that any SQL engine can reproduce."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = float(16**13)


def hash_key(seed: int | str, *columns: Column) -> Column:
    """md5 of ``seed:col:col…``: a shuffle order."""
    parts = [F.lit(str(seed))]
    for c in columns:
        parts += [F.lit(":"), c.cast("string")]
    return F.md5(F.concat(*parts).cast("binary"))


def uniform(seed: int | str, *columns: Column) -> Column:
    """A double in [0, 1) from the first 13 hex digits of ``hash_key``: 52 bits, exact in a double."""
    return F.conv(F.substring(hash_key(seed, *columns), 1, 13), 16, 10).cast("double") / F.lit(SCALE)


def normal(seed: int | str, *columns: Column) -> Column:
    """A standard normal draw by Box-Muller from two uniforms."""
    u, v = uniform(f"{seed}a", *columns), uniform(f"{seed}b", *columns)
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(F.lit(6.283185307179586) * v)
