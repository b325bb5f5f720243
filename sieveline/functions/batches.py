"""How many bytes of rows reach a Python worker at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of rows that are handed to a Python worker at once, and of text that a worker handles at once.
BATCH_BYTES = 4_000_000


def small_batches(spark: SparkSession) -> None:
    """Hand Python workers at most ``BATCH_BYTES`` of rows at a time.

    Texts and pictures are long: the session's usual 64 MB a batch are held several
    times over, by the executor and by each of its workers.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


KINDS = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def grouped(rows: Iterable[tuple], names: Sequence[str], kinds: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows as batches, each handed out when its bytes pass an eighth of ``BATCH_BYTES``."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(zip(*held), kinds)], names=list(names))

    for row in rows:
        held.append(row)
        size += sum(len(v) if isinstance(v, (bytes, str)) else 8 for v in row)
        if size > BATCH_BYTES // 8:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()
