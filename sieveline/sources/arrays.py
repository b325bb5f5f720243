"""Stored arrays (``.npy``, ``.npz``) read by ranges of rows, and banks of features."""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from sieveline.sources.files import deleted, located, save
from sieveline.sources.scratch import materialise

SCHEMA = "path string, name string, row_id long, value array<{}>"
STEP = 1 << 22  # bytes read and handed on at a time


@dataclass
class Rows(InputPartition):
    """Rows ``first`` to ``end`` of one array: where its numbers begin, and how they lie."""

    path: str
    name: str | None
    offset: int | None  # None: the member is compressed, and is read from its start
    first: int
    end: int


def _header(stream) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_columns, dtype = read(stream)
    if dtype.hasobject or dtype.names:
        raise ValueError("arrays of objects or records can't be read")
    return shape or (1,), by_columns, dtype


@contextmanager
def _opened(path: str, name: str | None) -> Iterator:
    files, where = located(path)
    with files.open_input_file(where) as stream:
        if name is None:
            yield stream
        else:
            with zipfile.ZipFile(stream) as box, box.open(f"{name}.npy") as member:
                yield member


def _members(path: str) -> list[tuple[str | None, int | None, tuple, np.dtype]]:
    """(name, where numbers begin, shape, type) of the arrays of a file."""
    if not path.endswith(".npz"):
        with _opened(path, None) as stream:
            shape, _, dtype = _header(stream)
            return [(None, stream.tell(), shape, dtype)]
    files, where = located(path)
    out = []
    with files.open_input_file(where) as stream, zipfile.ZipFile(stream) as box:
        for info in box.infolist():
            with box.open(info) as member:
                shape, _, dtype = _header(member)
                head = member.tell()
            offset = None
            if info.compress_type == zipfile.ZIP_STORED:
                stream.seek(info.header_offset + 26)  # the lengths of the local name and extra field
                name, extra = np.frombuffer(stream.read(4), "<u2")
                offset = info.header_offset + 30 + int(name) + int(extra) + head
            out.append((info.filename.removesuffix(".npy"), offset, shape, dtype))
    return out


def _exactly(stream, size: int) -> bytes:
    """``size`` bytes; an error where the file ends before."""
    parts = []
    while size:
        part = stream.read(size)
        if not part:
            raise EOFError("the file ends within an array")
        parts.append(part)
        size -= len(part)
    return b"".join(parts)


def _slices(part: Rows) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows as a matrix) in steps of about ``STEP`` bytes."""
    with _opened(part.path, part.name) as stream:
        shape, by_columns, dtype = _header(stream)
    across = int(np.prod(shape[1:], dtype=np.int64))
    step = max(1, STEP // max(1, across * dtype.itemsize))
    by_columns = by_columns and len(shape) > 1
    if part.offset is None:
        with _opened(part.path, part.name) as stream:
            _header(stream)
            if by_columns:  # rows lie across the member: no way but to hold it
                whole = np.frombuffer(_exactly(stream, shape[0] * across * dtype.itemsize), dtype)
                whole = whole.reshape(shape, order="F").reshape(shape[0], across)
                yield from ((a, whole[a : a + step]) for a in range(0, shape[0], step))
                return
            for a in range(0, shape[0], step):
                n = min(step, shape[0] - a)
                yield a, np.frombuffer(_exactly(stream, n * across * dtype.itemsize), dtype).reshape(n, across)
        return
    files, where = located(part.path)
    with files.open_input_file(where) as stream:
        for a in range(part.first, part.end, step):
            n = min(step, part.end - a)
            if not by_columns:
                stream.seek(part.offset + a * across * dtype.itemsize)
                yield a, np.frombuffer(_exactly(stream, n * across * dtype.itemsize), dtype).reshape(n, across)
                continue
            columns = []
            for c in range(across):
                stream.seek(part.offset + (c * shape[0] + a) * dtype.itemsize)
                columns.append(np.frombuffer(_exactly(stream, n * dtype.itemsize), dtype))
            yield a, np.array(columns).reshape(*shape[:0:-1], n).T.reshape(n, across)


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.size = json.loads(options["files"]), int(options["bytes"])
        self.element = np.dtype("f4" if options["element"] == "float" else "f8")

    def partitions(self) -> list[Rows]:
        with ThreadPoolExecutor(16) as pool:
            found = list(pool.map(_members, self.paths))
        out = []
        for path, members in zip(self.paths, found):
            for name, offset, shape, dtype in members:
                row = max(1, int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize)
                step = max(1, self.size // row) if offset is not None else max(1, shape[0])
                out += [Rows(path, name, offset, a, min(a + step, shape[0])) for a in range(0, shape[0], step)]
        return out or [Rows("", None, None, 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part.first == part.end:
            return
        for first, rows in _slices(part):
            n, across = rows.shape
            lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * across, pa.array(rows.astype(self.element).ravel()))
            text = lambda s: pa.array([s] * n, pa.string())
            yield pa.RecordBatch.from_arrays([text(part.path), text(part.name), pa.array(np.arange(first, first + n)), lists], ["path", "name", "row_id", "value"])


@dataclass
class Part(WriterCommitMessage):
    attempt: str


class ArrayWriter(DataSourceArrowWriter):
    """A ``.npy`` for each batch, below a staging folder; files of attempts that didn't count go at the end."""

    def __init__(self, options: dict) -> None:
        self.target, self.staging = options["path"], options["staging"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        files, root = located(self.staging)
        part = Part(uuid.uuid4().hex)
        for k, batch in enumerate(iterator):
            values = batch.column(0)
            if not len(values):
                continue
            rows = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
            with files.open_output_stream(f"{root}/{part.attempt}-{k}.npy") as out:
                np.lib.format.write_array(out, np.ascontiguousarray(rows), allow_pickle=False)
        return part

    def commit(self, messages: list) -> None:
        files, root = located(self.staging)
        good = {m.attempt for m in messages if m}
        for info in files.get_file_info(fs.FileSelector(root)):
            if info.base_name.rsplit("-", 1)[0] not in good:
                files.delete_file(info.path)
        files.move(root, located(self.target)[1])

    def abort(self, messages: list) -> None:
        deleted(self.staging)


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sieveline_arrays"

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(dict(self.options))

    def schema(self) -> str:
        return SCHEMA.format(self.options["element"])

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(dict(self.options))


def read_rows(spark: SparkSession, pattern: str, *, element: str = "double", task_bytes: int = 64 << 20) -> DataFrame:
    """(path, name, row_id, value) of ``.npy`` and ``.npz`` files: a row for each first-axis entry,
    flattened in C order; ``name`` is null in ``.npy``.

    An array is read in ranges of about ``task_bytes`` by as many tasks, a few MB
    at a time; compressed members of an ``.npz`` are streamed by one task each.
    A single number is one row, an empty array none.  Arrays of objects, and
    files that end early, are errors.  The driver reads headers only.
    """
    spark.dataSource.register(ArraySource)
    listed = spark.read.format("binaryFile").load(pattern).select("path").collect()  # names only
    options = {"files": json.dumps(sorted(r["path"] for r in listed)), "bytes": str(task_bytes), "element": element}
    return spark.read.format("sieveline_arrays").options(**options).load()


def write_rows(rows: DataFrame, path: str, column: str) -> None:
    """Write the vectors in ``column`` as ``.npy`` files of some thousand rows below ``path``.

    All vectors must have one length, and none may be null or hold a null: that
    is an error before anything is written, as is a ``path`` that exists.  Rows
    have no order.
    """
    value = F.col(column)
    odd = F.coalesce(F.exists(value, lambda x: x.isNull()), F.lit(True))
    told = rows.agg(F.count_if(odd).alias("odd"), F.min(F.size(value)).alias("least"), F.max(F.size(value)).alias("most")).head()
    if told["odd"] or told["least"] != told["most"] or told["least"] == 0:
        raise ValueError(f"{column} has nulls or vectors of different lengths")
    rows.sparkSession.dataSource.register(ArraySource)
    save(rows.select(column), "sieveline_arrays", path)


def numbered_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one file of lines with ``row_id``, their place in it from 0.

    A file's blocks are numbered by where they begin; rows within a block keep
    the order in which a task reads them.
    """
    rows = df.select(*columns, F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    rows = materialise(rows, "lines")
    sizes = rows.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))  # a row for each block
    before = F.sum("__n").over(Window.orderBy("__block")) - F.col("__n")
    placed = rows.join(sizes.select("__block", before.alias("__before")), "__block")
    own = F.row_number().over(Window.partitionBy("__block").orderBy("__at")) - 1
    return placed.withColumn("row_id", (own + F.col("__before")).cast("long")).select("row_id", *columns)


def read_bank(spark: SparkSession, folder: str, meta: str | StructType, splits: tuple[str, ...] = ("train", "val", "test")) -> tuple[DataFrame, dict]:
    """A stored bank: rows of all splits as (split, row_id, value, columns of ``meta``), and its description.

    ``feat_<split>.npy`` holds vectors, ``meta_<split>.csv`` their facts in the
    same order, ``feature_bank_info.json`` the description.  A missing file is an
    error; rows that only one of both has stay, with nulls for the other.
    """
    schema = StructType.fromDDL(meta) if isinstance(meta, str) else meta
    names = [f.name for f in schema if f.name not in ("split", "row_id")]
    out = None
    for split in splits:
        vectors = read_rows(spark, f"{folder}/feat_{split}.npy", element="float").select("row_id", "value")
        lines = spark.read.option("header", "true").schema(schema).csv(f"{folder}/meta_{split}.csv")
        one = vectors.join(numbered_lines(lines, names), "row_id", "full").select(F.lit(split).alias("split"), "row_id", "value", *names)
        out = one if out is None else out.unionByName(one)
    info = spark.read.text(f"{folder}/feature_bank_info.json", wholetext=True).head()
    return out, json.loads(info["value"]) if info else {}
