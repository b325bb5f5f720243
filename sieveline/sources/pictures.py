"""A sink of pictures: a JPEG for each row, all of them or none."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from sieveline.functions.jpeg import encode
from sieveline.sources.files import absent, deleted, located, save


def _encoded(row: dict, quality: int) -> bytes | None:
    """The row's file; None without data or where the data don't fill the sizes."""
    shape = row["height"], row["width"], row["channels"]
    if row["data"] is None or None in shape or shape[2] not in (1, 3) or not all(0 < s < 65536 for s in shape) or len(row["data"]) != np.prod(shape, dtype=np.int64):
        return None
    return encode(np.frombuffer(row["data"], np.uint8).reshape(shape), quality)


class PictureWriter(DataSourceArrowWriter):
    """Writes below a staging folder; the end of the job names it as asked, or deletes it.

    A file is renamed when it is whole, and its name follows from its row, so a
    task that runs twice leaves what it would leave once.  Tasks never create the
    staging folder itself, so one that outlives the job can't bring it back.
    """

    def __init__(self, options: dict) -> None:
        self.target, self.quality = options["path"].rstrip("/"), int(options["quality"])
        self.staging = options["staging"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = located(self.staging)
        part, made = uuid.uuid4().hex, set()

        def put(folder: str, name: str, content: bytes) -> None:
            if folder not in made:
                files.create_dir(f"{root}/{folder}", recursive=False)
                made.add(folder)
            draft = f"{root}/_drafts-{part}"
            with files.open_output_stream(draft) as out:
                out.write(content)
            files.move(draft, f"{root}/{folder}/{name}")

        report = []
        for batch in iterator:
            for at in range(batch.num_rows):  # a picture at a time
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                content = _encoded(row, self.quality)
                if content is not None:
                    put(row["folder"], row["name"], content)
                report.append(json.dumps({"folder": row["folder"], "name": row["name"], "written": content is not None, "bytes": len(content or b"")}))
        if report:
            put("_written", f"{part}.json", "\n".join(report).encode())
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        files, root = located(self.staging)
        files.move(root, located(self.target)[1])

    def abort(self, messages: list) -> None:
        deleted(self.staging)


class PictureSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sieveline_pictures"

    def writer(self, schema: StructType, overwrite: bool) -> PictureWriter:
        return PictureWriter(dict(self.options))


def write_pictures(rows: DataFrame, path: str, *, folder: Column, name: Column, quality: int = 95) -> DataFrame:
    """Write ``rows`` (width, height, channels, data in BGR order) as ``path/<folder>/<name>`` and
    return (folder, name, written, bytes), a row for each of them.

    A row without data, or whose data don't fill its sizes, leaves no file and is
    told by ``written``.  Repeated names, names or folders that are null, empty,
    hidden or hold a slash, and a ``path`` that exists are errors before
    anything is written.  Sizes of 65536 and more have no JPEG.  A task holds one
    picture and its batch.  Tasks whose last attempt fails end the job without a
    trace; a report that an earlier attempt left is counted once.
    """
    spark = rows.sparkSession
    target, where = absent(path)
    rows = rows.select(folder.alias("folder"), name.alias("name"), "width", "height", "channels", "data")
    odd = lambda c: F.coalesce(F.col(c).rlike(r"^[._]|/|^$"), F.lit(True))
    faults = rows.groupBy("folder", "name").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | odd("folder") | odd("name"))
    if first := faults.head(1):
        raise ValueError(f"repeated or unfit name: {first[0]['folder']}/{first[0]['name']}")
    spark.dataSource.register(PictureSink)
    save(rows, "sieveline_pictures", path, quality=str(quality))
    schema = "folder string, name string, written boolean, bytes long"
    if target.get_file_info(f"{where}/_written").type.name == "NotFound":
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{path.rstrip('/')}/_written").distinct()
