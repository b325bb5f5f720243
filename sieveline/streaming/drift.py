"""A drift monitor on a stream: windowed moments against a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_moments(events: DataFrame, *, ts: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count, mean and deviation of each key in tumbling windows; rows later than
    the watermark are left out.  Works on batches and streams."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late)
    g = rows.groupBy(F.window(ts, width).alias("w"), key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return g.select(F.col("w.start").alias("start"), key, "n", "mean", "sd")


def flagged(moments: DataFrame, reference: DataFrame, *, key: str = "event_type", most_z: float = 3.0) -> DataFrame:
    """Windows whose mean is more than ``most_z`` standard errors from the reference's."""
    ref = reference.select(F.col(key).alias("k"), F.col("mean").alias("ref_mean"), F.col("sd").alias("ref_sd"))
    j = moments.join(F.broadcast(ref), F.col(key) == F.col("k")).drop("k")  # a row for each key of the reference
    z = F.try_divide(F.col("mean") - F.col("ref_mean"), F.col("ref_sd") / F.sqrt("n"))
    return j.withColumn("z", z).withColumn("drift", F.abs("z") > most_z)
