"""Joins on a list of keys that may be empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join(a: DataFrame, b: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Left join on ``by``; without keys ``b`` is one row of totals."""
    return a.join(b, list(by), how) if by else a.crossJoin(F.broadcast(b))


def cross(a: DataFrame | None, small: DataFrame) -> DataFrame:
    """Every row of ``a`` with every row of a small constant table."""
    return small if a is None else a.crossJoin(F.broadcast(small))
