"""Queries of the picture operators, over pictures drawn from ``embeddings``.

A row's picture is its vector as 8 x 8 gray levels, enlarged by a factor that
follows its label, on a black frame with a bright sign at a fixed place, as an
overlay.  One row in 50 can't be decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.config import Curation
from sieveline.functions.batches import grouped
from sieveline.operators import pictures as P
from sieveline.plans.tables import table

MARGIN = 24


def drawn(vector: np.ndarray, label: int) -> np.ndarray:
    """The picture of a vector, in BGR order."""
    a = np.asarray(vector, float).reshape(8, 8)
    levels = np.round(255 * (a - a.min()) / max(np.ptp(a), 1e-12))
    inner = np.kron(levels, np.ones((6 + label % 3, 6 + label % 3)))
    gray = np.pad(inner, MARGIN)
    gray[6:10, 6:16] = 230
    return np.clip(np.stack([0.9 * gray, gray, 0.8 * gray], axis=2), 0, 255).astype(np.uint8)


def pictures(spark, sf) -> DataFrame:
    """(vec_id, path, width, height, channels, data, decodable) of every row of ``embeddings``."""

    names = ["vec_id", "path", "width", "height", "channels", "data", "decodable"]
    kinds = ["long", "string", "int", "int", "int", "binary", "boolean"]

    def one(vec_id: int, vector: np.ndarray, label: int) -> tuple:
        image, fine = drawn(vector, label), vec_id % 50 != 3
        return vec_id, f"{vec_id:08d}.png", image.shape[1], image.shape[0], 3, image.tobytes() if fine else None, fine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (one(i.as_py(), v.values.to_numpy(zero_copy_only=False), n.as_py()) for batch in batches for i, v, n in zip(*batch.columns))
        return grouped(rows, names, kinds)

    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def frame_boxes(spark, sf):
    """The box free of overlays of each picture size."""
    return P.overlay_free_boxes(pictures(spark, sf))


def processed_pictures(spark, sf):
    """Each picture cropped to its size's box, equalised and resized: sizes, residuals and a digest."""
    boxes = frame_boxes(spark, sf).where("reason = 'ok'").select("width", "height", "x", "y", "w", "h")
    out = P.processed(pictures(spark, sf), boxes, size=32, border=Curation().border, flag=Curation().residual_flag)
    return out.select("path", "boxed", "cropped_w", "cropped_h", F.round("residual_before", 9).alias("residual_before"), F.round("residual_after", 9).alias("residual_after"), "flagged", "written", F.md5("data").alias("digest"))


def picture_hashes(spark, sf):
    """Perceptual codes of the pictures; 0 where one can't be decoded."""
    return P.picture_codes(pictures(spark, sf))


def picture_views(spark, sf):
    """The mean and extreme values of each plane of three training views of each picture."""
    rows = pictures(spark, sf).withColumn("row_id", F.col("vec_id"))
    made = P.view_rows(rows, number=3, train=True, seed=42, size=32)
    plane = lambda k: F.slice("planes", 1 + 32 * 32 * k, 32 * 32)
    mean = lambda k: F.round(F.aggregate(plane(k), F.lit(0.0), lambda a, x: a + x.cast("double")) / (32 * 32), 5)
    return made.select("row_id", "view", *[mean(k).alias(f"mean_{c}") for k, c in enumerate("rgb")], F.round(F.array_min("planes").cast("double"), 5).alias("least"), F.round(F.array_max("planes").cast("double"), 5).alias("most"))


QUERIES = {f.__name__: f for f in (frame_boxes, processed_pictures, picture_hashes, picture_views)}
ORACLES: dict[str, str] = {}
