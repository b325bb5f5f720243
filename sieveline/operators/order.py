"""Running sums and places in a global order, without a task that holds the order.

Values are dealt to ranges at approximate quantiles.  Sums of whole ranges, some
dozens of rows a group, give what comes before a range; within a range a window
does the rest.  Equal values share a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.sources.scratch import materialise

RANGES = 64


def ranged(df: DataFrame, key: str, *, descending: bool = False) -> DataFrame:
    """``df`` with ``__range``, which rises in the order of the numeric column ``key``; nulls come first."""
    places = [k / RANGES for k in range(1, RANGES)]
    cuts = df.agg(F.percentile_approx(F.col(key).cast("double"), places, 20 * RANGES).alias("__cuts"))  # one row
    below = F.size(F.filter("__cuts", lambda q: q < F.col(key).cast("double")))
    number = F.when(F.col(key).isNull(), -1).otherwise(below)
    return df.crossJoin(F.broadcast(cuts)).withColumn("__range", F.when(F.col(key).isNotNull(), -number).otherwise(-RANGES - 1) if descending else number).drop("__cuts")


def _same(a: Sequence[str], b: Sequence[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b):
        out &= F.col(x).eqNullSafe(F.col(y))
    return out


def running(table: DataFrame, by: Sequence[str], key: str, sums: Sequence[str], *, descending: bool = False, following: bool = False) -> DataFrame:
    """``table``, a row for each value of ``key`` in a group, with ``upto_c`` and ``all_c``
    for each column c of ``sums``: its sum over the group up to the row, and over all of it.

    ``following`` adds ``next_c``, c of the next row of the group, null at the end.
    """
    table = materialise(table, "ordered")  # read three times: for the quantiles, the ranges' sums and the rows
    rows = ranged(table, key, descending=descending)
    mine = F.desc(key) if descending else F.asc(key)
    first = (F.max_by if descending else F.min_by)(F.struct(*sums), key).alias("__first")
    parts = rows.groupBy(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], F.col("__range").alias("__part")).agg(*[F.sum(c).alias(f"__{c}") for c in sums], *([first] if following else []))
    own = [f"__by{k}" for k in range(len(by))]
    group, order = Window.partitionBy(*own), Window.partitionBy(*own).orderBy("__part")  # RANGES + 1 rows a group at most
    told = [x for c in sums for x in ((F.sum(f"__{c}").over(order) - F.col(f"__{c}")).alias(f"__before_{c}"), F.sum(f"__{c}").over(group).alias(f"all_{c}"))]
    parts = parts.select(*own, "__part", *told, *([F.lead("__first").over(order).alias("__then")] if following else []))
    joined = rows.join(parts, _same([*by, "__range"], [*own, "__part"]))
    within = Window.partitionBy(*by, "__range").orderBy(mine)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {f"upto_{c}": F.sum(c).over(upto) + F.col(f"__before_{c}") for c in sums}
    if following:
        new |= {f"next_{c}": F.coalesce(F.lead(c).over(within), F.col("__then")[c]) for c in sums}
    return joined.withColumns(new).select(*[F.col(c) for c in table.columns], *new, *[f"all_{c}" for c in sums])


def placed(df: DataFrame, key: str, tie: str, name: str = "place") -> DataFrame:
    """``df`` with the 1-based ``name`` of each row in the order of ``key``, then ``tie``, and ``all``, the number of rows."""
    df = materialise(df, "ordered")
    rows = ranged(df, key)
    order = Window.orderBy("__part")  # RANGES + 1 rows at most
    parts = rows.groupBy(F.col("__range").alias("__part")).agg(F.count(F.lit(1)).alias("__c"))
    parts = parts.select("__part", (F.sum("__c").over(order) - F.col("__c")).alias("__before"), F.sum("__c").over(Window.partitionBy()).alias("all"))
    joined = rows.join(parts, _same(["__range"], ["__part"]))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(F.asc_nulls_first(key), tie))
    return joined.withColumn(name, within + F.col("__before")).select(*df.columns, name, "all")
