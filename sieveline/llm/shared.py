"""Small text and column expressions that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.batches import BATCH_BYTES, small_batches  # noqa: F401
from sieveline.sources.scratch import clear_scratch, drop_path, materialise, rekeyed, scratch_path, scratch_root  # noqa: F401

#: The six ASCII white-space characters 0x20 and 0x09-0x0D as a Java class.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def crc32_of_id(column: str) -> Column:
    """crc32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """``new`` after the other columns; a column of the same name is replaced."""
    keep = [F.col(f"`{c}`") for c in df.columns if c not in new]
    return df.select(*keep, *[v.alias(k) for k, v in new.items()])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def chunks(texts: list[str], most_rows: int, most_chars: int = BATCH_BYTES // 8) -> Iterator[slice]:
    """Consecutive slices of ``texts`` of at most ``most_rows`` texts and about
    ``most_chars`` characters; a longer text is a slice of its own."""
    begin, held = 0, 0
    for k, t in enumerate(texts):
        if k > begin and (k - begin >= most_rows or held + len(t) > most_chars):
            yield slice(begin, k)
            begin, held = k, 0
        held += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


def emptied_after(forget: Callable[[], None]) -> Callable:
    """Call ``forget`` when a task ends.  Workers are used again by other
    operators, which need the memory of tables.  ``forget`` must be a module's
    own function, so that it reaches the worker's tables and not a copy."""

    def wrap(run: Callable) -> Callable:
        def task(batches: Iterator) -> Iterator:
            try:
                yield from run(batches)
            finally:
                forget()

        return task

    return wrap


#: Most hash buckets that a filter broadcasts; integers of about 100 MB in all.
MOST_BUCKETS = 1 << 22


def in_buckets(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows whose key falls in a hash bucket of the wanted keys: all wanted
    rows, and one in eight others.

    The number of buckets follows that of the wanted keys.  Beyond
    ``MOST_BUCKETS`` the keys are joined instead, with an exchange of the rows.
    """
    n = wanted.agg(F.count(F.lit(1))).first()[0]
    buckets = 1 << max(10, (8 * n).bit_length())
    if buckets > MOST_BUCKETS:
        keys = wanted.select(F.col(wanted_key).alias("__wanted")).distinct()
        return rows.join(keys, F.col(key) == F.col("__wanted"), "left_semi")
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
    ids = materialise(wanted.select(bucket(wanted_key).alias("__wanted")).distinct(), "wanted")
    return rows.join(F.broadcast(ids), bucket(key) == F.col("__wanted"), "left_semi")
