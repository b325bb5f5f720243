"""Sources and sinks: image inventories, typed CSV and JSON, arrays, states, grids."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions.images import jpeg_size
from sieveline.functions.rng import uniform

#: Text for infinities in CSV, both ways; Spark would read it as null otherwise.
CSV_OPTIONS = {"header": "true", "positiveInf": "inf", "negativeInf": "-inf", "nanValue": "nan"}


@F.pandas_udf(T.StructType([T.StructField("w", T.IntegerType()), T.StructField("h", T.IntegerType())]))
def _header(content: pd.Series) -> pd.DataFrame:
    sizes = [jpeg_size(c) for c in content]
    return pd.DataFrame({"w": [s[0] if s else None for s in sizes], "h": [s[1] if s else None for s in sizes]}).astype("Int32")


def image_inventory(spark: SparkSession, root: str, classes: Sequence[str], abnormal: Sequence[str]) -> DataFrame:
    """A row for each file below ``root/<class>``: id, class, size by header only, md5, validity.

    A class without a folder is an error.  Files whose header can't be read are
    kept with size -1 and ``valid`` false.
    """
    rows = spark.read.format("binaryFile").load([f"{root}/{c}" for c in classes])
    name, label = F.regexp_extract("path", r"([^/]+)$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    index = F.create_map(*[x for k, c in enumerate(classes) for x in (F.lit(c), F.lit(k))])
    out = rows.select(F.url_decode(label).alias("class_label"), F.col("path").alias("src_path"), F.url_decode(name).alias("filename"), _header("content").alias("s"), F.md5("content").alias("md5"))
    out = out.withColumn("image_id", F.concat_ws("__", F.replace("class_label", F.lit(" "), F.lit("_")), "filename"))
    return out.select(
        "image_id", "class_label", "src_path", "filename", F.coalesce("s.w", F.lit(-1)).alias("width_px"), F.coalesce("s.h", F.lit(-1)).alias("height_px"),
        "md5", F.col("s.w").isNotNull().alias("valid"), index[F.col("class_label")].alias("class_idx"), F.col("class_label").isin(*abnormal).cast("int").alias("binary_label"),
    )


def read_pictures(spark: SparkSession, root: str, classes: Sequence[str]) -> DataFrame:
    """(path, width, height, channels, data, decodable) for each file below ``root/<class>``.

    ``data`` are rows of bytes in BGR order.  A file that can't be decoded stays,
    with sizes of -1 and without data.
    """
    rows = spark.read.format("image").option("dropInvalid", "false").load([f"{root}/{c}" for c in classes])
    valid = F.col("image.nChannels") > 0
    sizes = [F.col(f"image.{c}").alias(n) for c, n in (("width", "width"), ("height", "height"), ("nChannels", "channels"))]
    return rows.select(F.col("image.origin").alias("path"), *sizes, F.when(valid, F.col("image.data")).alias("data"), valid.alias("decodable"))


def read_npz(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, name, row_id, value array<double>) of ``.npz`` files: a row for each first-axis entry of each array."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
                    for name in arrays.files:
                        a = np.atleast_1d(arrays[name])
                        flat = a.reshape(len(a), -1).astype(np.float64)
                        yield pd.DataFrame({"path": path, "name": name, "row_id": np.arange(len(a)), "value": list(flat)})

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInPandas(rows, "path string, name string, row_id long, value array<double>")


def read_states(spark: SparkSession, path: str, **run: object) -> DataFrame | None:
    """The states that ``write_states`` left, of one run if its keys are given; None where there are none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    states = spark.read.parquet(path)
    for key, value in run.items():
        states = states.where(F.col(key) == F.lit(value))
    return states


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)


def read_optional(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame | None:
    """A CSV, or None where there is none, so that dependent outputs can be left out."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return read_csv(spark, path, schema) if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target) else None


def write_csv(df: DataFrame, path: str) -> None:
    """NaN and infinities as text; arrays and maps as JSON."""
    flat = [F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_arrays(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, row_id, value array<float>) of ``.npy`` files, one row for each first-axis entry."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
                flat = a.reshape(len(a), -1)
                yield pd.DataFrame({"path": path, "row_id": np.arange(len(a)), "value": list(flat)})

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(rows, "path string, row_id long, value array<float>")


def write_states(states: DataFrame, path: str, main_alpha: float) -> None:
    """Model states of the main alpha only, by method and seed."""
    states.where(F.col("alpha") == main_alpha).write.mode("overwrite").partitionBy("method", "seed").parquet(path)


def missing_runs(grid: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of the run grid without a stored state."""
    return grid.join(found.select(*keys).distinct(), list(keys), "left_anti")


def run_grid(spark: SparkSession, axes: dict[str, Sequence]) -> DataFrame:
    """The product of constant axes."""
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def alpha_tag(alpha: Column) -> tuple[Column, Column]:
    """(text, number) of a concentration: ``inf`` and 1e9 for infinity."""
    return F.when(alpha == float("inf"), "inf").otherwise(F.regexp_replace(alpha.cast("string"), r"\.0$", "")), F.when(alpha == float("inf"), 1e9).otherwise(alpha)


def synthetic_labels(spark: SparkSession, n: int, weights: Sequence[float], seed: int) -> DataFrame:
    """(row_id, label): weighted categorical draws by inverse distribution of seeded uniforms."""
    cum = np.cumsum(weights) / np.sum(weights)
    below = F.filter(F.array(*[F.lit(float(c)) for c in cum[:-1]]), lambda c: c <= uniform(seed, F.col("id")))
    return spark.range(n).select(F.col("id").alias("row_id"), F.size(below).alias("label"))
