"""Decoded pictures as rows: codes, crops free of overlays, and views for encoders.

Pictures reach Python in Arrow batches of ``BATCH_BYTES``; crops are decoded one by
one and leave in batches of an eighth of that, so a task holds two small batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions import images as I
from sieveline.functions.batches import grouped, small_batches
from sieveline.functions.rng import hash_key
from sieveline.sources.scratch import materialise

if TYPE_CHECKING:
    import pandas as pd  # workers that don't need it stay without

#: Boxes beyond this number are joined instead of broadcast.
MOST_BOXES = 10_000


def _decoded(row) -> np.ndarray | None:
    """Three planes in BGR order; gray is repeated and transparency is dropped."""
    if not row.decodable:
        return None
    image = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
    return np.repeat(image, 3, axis=2) if row.channels == 1 else image[..., :3]


def _pictures(batches: Iterator[pa.RecordBatch]) -> Iterator[SimpleNamespace]:
    """The rows, one picture at a time."""
    for batch in batches:
        for n in range(len(batch)):
            yield SimpleNamespace(**{c: batch.column(c)[n].as_py() for c in batch.schema.names})


def _resized(image: np.ndarray, size: int) -> np.ndarray:
    if image.shape[:2] == (size, size):
        return image
    planes = [I.area_resize(image[..., c].astype(float), size, size) for c in range(3)]
    return np.round(np.stack(planes, axis=2)).astype(np.uint8)


def picture_codes(pictures: DataFrame) -> DataFrame:
    """(path, code, decodable): the perceptual code of a picture's luminance, 0 if it can't be decoded."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        weight = np.array([0.114, 0.587, 0.299])
        for frame in frames:
            images = [_decoded(row) for row in frame.itertuples()]
            codes = [0 if i is None else I.perceptual_code(i @ weight) for i in images]
            yield pd.DataFrame({"path": frame["path"], "code": codes, "decodable": frame["decodable"]})

    small_batches(pictures.sparkSession)
    return pictures.mapInPandas(run, "path string, code long, decodable boolean")


def processed(
    pictures: DataFrame,
    boxes: DataFrame,
    *,
    size: int = 224,
    border: int = 12,
    flag: float = 1e-3,
    contrast: Callable[[np.ndarray], np.ndarray] | None = I.equalised_lightness,
) -> DataFrame:
    """Each picture cropped to its size's box, or else to what is brighter than its border, and resized.

    ``boxes`` has (width, height, x, y, w, h), a row for a size at most; a box
    outside of the picture counts as none.  ``contrast`` equalises a crop before it
    is resized; None leaves it as it is.
    Returns path, boxed, cropped_w, cropped_h, the shares of overlay pixels before
    and after the crop, whether the latter is over ``flag``, written, and ``data``
    (BGR bytes, size x size).  A picture that can't be decoded has sizes of -1,
    null shares, no data, and isn't flagged.
    """
    few = boxes.limit(MOST_BOXES + 1).count() <= MOST_BOXES
    joined = pictures.join(F.broadcast(boxes) if few else boxes, ["width", "height"], "left")

    def one(row) -> tuple:
        image = _decoded(row)
        if image is None:
            return row.path, False, -1, -1, None, None, False, False, None
        crop = I.apply_box(image, (row.x, row.y, row.w, row.h)) if row.x is not None else None
        boxed = crop is not None and crop.size > 0
        crop = crop if boxed else I.crop_border(image, border)
        after = I.overlay_residual(crop)
        out = _resized(contrast(crop) if contrast else crop, size)
        return row.path, boxed, crop.shape[1], crop.shape[0], I.overlay_residual(image), after, after > flag, True, out.tobytes()

    names = ["path", "boxed", "cropped_w", "cropped_h", "residual_before", "residual_after", "flagged", "written", "data"]
    kinds = ["string", "boolean", "int", "int", "double", "double", "boolean", "boolean", "binary"]
    taken = ["path", "width", "height", "channels", "data", "decodable", *[F.col(c).cast("int").alias(c) for c in "xywh"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return grouped((one(row) for row in _pictures(batches)), names, kinds)

    small_batches(pictures.sparkSession)
    return joined.select(*taken).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


#: Pixels of a band of rows, whose sums travel together, and bytes of sums that a task holds.
BAND, HELD = 1 << 16, 256_000_000
SUMS = "width int, height int, band int, n long, total binary, squares binary"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """Rows of ``SUMS`` added up by width, height and band."""
    held: dict[tuple, list] = {}
    for batch in batches:
        for width, height, band, n, total, squares in zip(*(c.to_pylist() for c in batch.columns)):
            got = held.setdefault((width, height, band), [0, 0, 0])
            got[0], got[1], got[2] = got[0] + n, got[1] + np.frombuffer(total, np.int64), got[2] + np.frombuffer(squares, np.int64)
    yield from held.items()


def _rows(held: Iterator[tuple[tuple, list]]) -> Iterator[pa.RecordBatch]:
    for (width, height, band), (n, total, squares) in held:
        columns = [[width], [height], [band], [n], [total.tobytes()], [squares.tobytes()]]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in SUMS.split(", ")])


def pixel_sums(pictures: DataFrame, ways: int = 16) -> DataFrame:
    """``SUMS`` of the gray levels of all decodable pictures, by size and band of rows.

    Tasks sum their own pictures as they come; sums are merged in ``ways`` ways
    and then in one, so no task holds a stack of pictures.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0
        for row in _pictures(batches):
            image = _decoded(row)
            if image is None:
                continue
            gray = I.luminance(image).astype(np.int64)
            rows = max(1, BAND // gray.shape[1])
            for band, y in enumerate(range(0, gray.shape[0], rows)):
                part = gray[y : y + rows].reshape(-1)
                got = held.get((gray.shape[1], gray.shape[0], band))
                if got is None:
                    held[gray.shape[1], gray.shape[0], band] = [1, part, part * part]
                    size += 2 * part.nbytes
                else:
                    got[0] += 1
                    got[1] += part
                    got[2] += part * part
            if size > HELD:
                yield from _rows(iter(held.items()))
                held, size = {}, 0
        yield from _rows(iter(held.items()))

    small_batches(pictures.sparkSession)
    taken = pictures.select("width", "height", "channels", "data", "decodable").mapInArrow(own, SUMS)
    keys = ["width", "height", "band"]
    once = taken.withColumn("way", F.pmod(F.monotonically_increasing_id(), F.lit(ways))).repartition(*keys, "way").drop("way")
    return once.mapInArrow(lambda b: _rows(_summed(b)), SUMS).repartition(*keys).mapInArrow(lambda b: _rows(_summed(b)), SUMS)


def overlay_free_boxes(pictures: DataFrame, *, sample: int = 300, least: int = 30, least_sd: float = 9.0, pad: int = 4, seed: int = 0, id_col: str = "path") -> DataFrame:
    """A crop box free of overlays for each size: width, height, n, reason, x, y, w, h.

    Overlays are where frames of one size don't vary.  Of each size, ``sample``
    frames are taken in seeded order (which is the feature); the pixels whose
    gray level's standard deviation passes ``least_sd`` are closed and opened,
    and the largest rectangle in the largest part, inset by ``pad``, is the box.

    ``n`` counts the frames of a size if they are fewer than ``least``
    (``too_few_frames``), else those of the sample that could be decoded, which
    may be too few as well (``unreadable``).  Where nothing varies the reason is
    ``no_content``; only ``ok`` has a box.  Rows with a null size or a size under
    1 are left out, null names aren't sampled; rows that repeat a name are taken
    together; an empty table gives no row.
    """
    sized = pictures.where("width > 0 AND height > 0")
    keys = ["width", "height"]
    # Sizes and names are read off the pictures once.
    named = materialise(sized.select(*keys, F.col(f"`{id_col}`").alias("__name")), "frame-names")
    counts = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"))
    enough = counts.where(F.col("frames") >= least)
    # The frames are chosen by name alone; their bytes stay where they are if the names are few.
    names = named.join(enough.select(*keys), keys, "left_semi")
    order = Window.partitionBy(*keys).orderBy(hash_key(seed, F.col("__name").cast("string")), "__name")
    names = materialise(names.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample).select("__name").distinct(), "frames")
    few = names.limit(MOST_BOXES + 1).count() <= MOST_BOXES
    sums = pixel_sums(sized.join(F.broadcast(names) if few else names, F.col(f"`{id_col}`") == F.col("__name"), "left_semi"))

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [I.varies(n, np.frombuffer(t, np.int64), np.frombuffer(q, np.int64), least_sd) for n, t, q in zip(*(batch.column(c).to_pylist() for c in ("n", "total", "squares")))]
            bits = pa.array([np.packbits(x).tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("width", "height", "band", "n")), pa.array([len(x) for x in found], pa.int32()), bits], names=["width", "height", "band", "n", "pixels", "bits"])

    def boxed(frame: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        first = frame.iloc[0]
        out = {"width": first.width, "height": first.height, "n": first.n, "reason": "unreadable", "x": None, "y": None, "w": None, "h": None}
        if first.n >= least:
            parts = [np.unpackbits(np.frombuffer(r.bits, np.uint8), count=r.pixels) for r in frame.sort_values("band").itertuples()]
            found = I.content_box(I.content_mask(np.concatenate(parts).reshape(first.height, first.width)), pad)
            out |= {"reason": "ok" if found else "no_content"} | dict(zip("xywh", found or [None] * 4))
        return pd.DataFrame([out]).astype({c: "Int32" for c in "xywh"})

    masks = sums.mapInArrow(flags, "width int, height int, band int, n long, pixels int, bits binary")  # one bit a pixel
    found = materialise(masks.groupBy(*keys).applyInPandas(boxed, "width int, height int, n long, reason string, x int, y int, w int, h int"), "frame-boxes")
    told = counts.join(found, keys, "left")
    few = F.col("frames") < least
    reason = F.when(few, "too_few_frames").otherwise(F.coalesce("reason", F.lit("unreadable")))
    return told.select(*keys, F.when(few, F.col("frames")).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n"), reason.alias("reason"), "x", "y", "w", "h")


def view_rows(pictures: DataFrame, *, number: int, train: bool, seed: int, size: int = 224, id_col: str = "row_id") -> DataFrame:
    """(row_id, view, planes): the normalised planes of each of a picture's views, the first of which is the picture itself.

    A picture that can't be decoded is black.  Views depend on the seed, the id
    and the view's number only, so a lost task makes the same ones again.
    """
    id_type = pictures.schema[id_col].dataType.simpleString()
    rows = pictures.withColumn("__id", F.col(f"`{id_col}`"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for frame in frames:
            for key, row in zip(frame["__id"], frame.itertuples()):
                image = _decoded(row)
                image = np.zeros((size, size, 3), np.uint8) if image is None else _resized(image, size)
                for k in range(number):
                    planes = I.normalised_planes(I.view(image, int(key), k, train=train, seed=seed))
                    yield pd.DataFrame({id_col: [key], "view": [k], "planes": [planes.reshape(-1)]})

    small_batches(pictures.sparkSession)
    return rows.mapInPandas(run, f"`{id_col}` {id_type}, view int, planes array<float>")
