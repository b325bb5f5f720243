"""Scratch tables in the shared folder named by ``spark.checkpoint.dir``.

A written table cuts the lineage, and every executor can read it, so a lost
executor only costs the tasks that were running on it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables; a temporary one where none is set
    and everything runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sieveline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sieveline"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to a scratch table and return the table."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete one scratch table."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every scratch table in this session's shared folder."""
    drop_path(spark, scratch_root(spark))


def rekeyed(column: Column, kind: str = "long") -> Column:
    """``column``, as an expression whose partitioning Spark doesn't know.

    A table that was just grouped by a key would be joined on it without a new
    exchange, and adaptive execution can only split a hot key where both sides
    of the join are exchanged for that join.  The regrouped side is small.
    """
    return F.concat(column, F.lit("")) if kind == "string" else column.bitwiseXOR(F.lit(0).cast("long"))


def bucketed(df: DataFrame, label: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """``bucketed_table`` as a DataFrame."""
    return df.sparkSession.table(bucketed_table(df, label, keys, buckets))


def bucketed_table(df: DataFrame, label: str, keys: list[str], buckets: int | None = None) -> str:
    """Write ``df`` as a scratch table in hash buckets of ``keys``, each sorted; its name.

    Tables with as many buckets are joined on the keys without an exchange.
    The number follows the session's shuffle partitions if none is given.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    name = f"scratch_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return name


def drop_table(spark: SparkSession, name: str) -> None:
    """Delete one table of ``bucketed_table`` with its files."""
    rows = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").collect()
    spark.sql(f"DROP TABLE {name}")
    for row in rows:
        drop_path(spark, row["data_type"])
