"""The driver tables as the engine's inputs, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.arrays import argmax, softmax

CLASSES = [0, 1, 2, 3, 4]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Binary labels and two scores from ``embeddings``."""
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", (F.col("label") >= 5).cast("int").alias("y"), F.get("embedding", F.lit(0)).cast("double").alias("s"), F.get("embedding", F.lit(1)).cast("double").alias("s2")
    )


SCORED = "scored AS (SELECT vec_id, label, (label >= 5)::INT AS y, embedding[1]::DOUBLE AS s, embedding[2]::DOUBLE AS s2 FROM embeddings)"


def posteriors(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, y5, l, p, conf, pred): a five-class softmax of the first five components."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", (F.col("label") % 5).alias("y5"), F.transform(F.slice("embedding", 1, 5), lambda x: 8 * x.cast("double")).alias("l"))
    rows = rows.withColumn("p", softmax(F.col("l")))
    return rows.withColumn("conf", F.array_max("p")).withColumn("pred", argmax(F.col("p")))


def sql_softmax(source: str, column: str, out: str, name: str, keep: str) -> str:
    return f"""{name}_e AS (SELECT {keep}, {column}, list_transform({column}, lambda v: exp(v - list_max({column}))) AS e_ FROM {source}),
{name} AS (SELECT {keep}, {column}, list_transform(e_, lambda v: v / list_sum(e_)) AS {out} FROM {name}_e)"""


POSTERIORS = (
    "logits AS (SELECT vec_id, label, label % 5 AS y5, list_transform(embedding[1:5], lambda x: 8 * x::DOUBLE) AS l FROM embeddings),\n"
    + sql_softmax("logits", "l", "p", "soft", "vec_id, label, y5")
    + ",\npost AS (SELECT *, list_max(p) AS conf, list_position(p, list_max(p)) - 1 AS pred FROM soft)"
)


def values(rows: Sequence[Sequence], names: str) -> str:
    """A SQL VALUES table."""

    def lit(x) -> str:
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(lit, x)) + "]"
        if isinstance(x, str):
            return f"'{x}'"
        if isinstance(x, float):
            return "'inf'::DOUBLE" if x == float("inf") else f"{x!r}::DOUBLE"
        return str(x)

    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names})"


ENTROPY = "-list_sum(list_transform({p}, lambda q: q * ln(greatest(q, 1e-12))))"
MARGIN = "(list_sort({p}, 'DESC'))[1] - (list_sort({p}, 'DESC'))[2]"
