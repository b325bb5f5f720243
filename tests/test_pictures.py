"""Pictures from files to crops, codes and views; stored arrays and states."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import images
from sieveline.operators import pictures as P
from sieveline.sources import readers


def png(bgr: np.ndarray) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = b"".join(b"\0" + row[:, ::-1].tobytes() for row in bgr)
    head = struct.pack(">IIBBBBB", bgr.shape[1], bgr.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def scene(width: int) -> np.ndarray:
    """A blue square on black, with a bright sign in the dark part."""
    out = np.zeros((60, width, 3), np.uint8)
    out[10:50, 30:70, 0] = 130
    out[4:6, 4:7] = 255
    return out


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pictures")
    (root / "a").mkdir()
    for name, data in {"one.png": png(scene(80)), "two.png": png(scene(90)), "bad.png": b"junk"}.items():
        (root / "a" / name).write_bytes(data)
    return readers.read_pictures(spark, str(root), ["a"])


def by_name(rows) -> dict:
    return {r.path.rsplit("/", 1)[-1]: r for r in rows.collect()}


def test_decoded_in_bgr_order(found):
    got = by_name(found)
    assert (got["one.png"].width, got["one.png"].height, got["one.png"].channels, got["one.png"].decodable) == (80, 60, 3, True)
    assert bytes(got["one.png"].data) == scene(80).tobytes()
    assert (got["bad.png"].width, got["bad.png"].data, got["bad.png"].decodable) == (-1, None, False)


def test_codes_of_what_is_not_decoded_are_zero(found):
    got = by_name(P.picture_codes(found))
    assert (got["bad.png"].code, got["bad.png"].decodable) == (0, False)
    gray = scene(80) @ np.array([0.114, 0.587, 0.299])
    assert got["one.png"].code == images.perceptual_code(gray) and got["one.png"].decodable


def test_processed_takes_the_box_or_the_border(spark, found):
    boxes = spark.createDataFrame([(80, 60, 30, 10, 40, 40), (90, 60, 500, 500, 5, 5)], "width int, height int, x int, y int, w int, h int")
    got = by_name(P.processed(found, boxes, size=16, contrast=None))
    one, two, bad = got["one.png"], got["two.png"], got["bad.png"]
    assert (one.boxed, one.cropped_w, one.cropped_h, one.residual_after, one.flagged) == (True, 40, 40, 0.0, False)
    assert one.residual_before == images.overlay_residual(scene(80)) > 0
    assert bytes(one.data) == np.broadcast_to(np.array([130, 0, 0], np.uint8), (16, 16, 3)).tobytes()
    # A box outside of the picture counts as none: the border's crop keeps the sign, which is flagged.
    assert (two.boxed, two.cropped_w, two.cropped_h, two.flagged, two.written) == (False, 66, 46, True, True)
    assert (bad.cropped_w, bad.residual_before, bad.flagged, bad.written, bad.data) == (-1, None, False, False, None)
    assert P.processed(found.limit(0), boxes).count() == 0 and P.processed(found, boxes.limit(0)).where("boxed").count() == 0


def test_views(found):
    rows = found.withColumn("row_id", F.when(F.col("decodable"), F.col("width")).otherwise(0))
    for train in (False, True):
        made = P.view_rows(rows, number=3, train=train, seed=1, size=32)
        got = {(r.row_id, r.view): np.array(r.planes, np.float32).reshape(3, 32, 32) for r in made.collect()}
        assert set(got) == {(k, v) for k in (0, 80, 90) for v in range(3)}
        black = images.normalised_planes(np.zeros((32, 32, 3), np.uint8))
        np.testing.assert_array_equal(got[0, 0], black)
        again = {(r.row_id, r.view): list(r.planes) for r in made.collect()}
        assert all(np.array_equal(np.array(again[k], np.float32).reshape(3, 32, 32), v) for k, v in got.items())
        if not train:
            np.testing.assert_array_equal(got[80, 1], got[80, 0][:, :, ::-1])
            np.testing.assert_array_equal(got[80, 2], got[80, 0][:, ::-1])


def test_border_needs_eight_bright_rows_and_columns():
    pic = np.zeros((40, 40, 3), np.uint8)
    pic[[2, 30]] = 255  # far apart, but only two rows
    assert images.crop_border(pic).shape == (40, 40, 3)
    pic[2:10] = 255
    assert images.crop_border(pic).shape == (29, 40, 3)


def test_stored_arrays_and_states(spark, tmp_path):
    np.savez(tmp_path / "p.npz", prob=np.arange(6.0).reshape(2, 3), y=np.array([1, 0]))
    got = {(r.name, r.row_id): list(r.value) for r in readers.read_npz(spark, str(tmp_path / "p.npz")).collect()}
    assert got == {("prob", 0): [0, 1, 2], ("prob", 1): [3, 4, 5], ("y", 0): [1], ("y", 1): [0]}
    states = spark.createDataFrame([("m", 1, 0.5, 3.0), ("m", 2, 0.5, 4.0), ("n", 1, 0.1, 5.0)], "method string, seed int, alpha double, w double")
    path = str(tmp_path / "states")
    assert readers.read_states(spark, path) is None
    readers.write_states(states, path, 0.5)
    assert readers.read_states(spark, path).count() == 2
    assert [r.w for r in readers.read_states(spark, path, method="m", seed=2).collect()] == [4.0]
    grid = readers.run_grid(spark, {"method": ["m", "n"], "seed": [1, 2]})
    missing = readers.missing_runs(grid, readers.read_states(spark, path), ["method", "seed"])
    assert {(r.method, r.seed) for r in missing.collect()} == {("n", 1), ("n", 2)}


def batch_bytes(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])


def test_pictures_reach_workers_in_small_batches(spark):
    from sieveline.functions.batches import BATCH_BYTES

    shown = spark.range(0, 300, 1, 1).selectExpr("id AS row_id", "cast(id AS string) AS path", "100 AS width", "100 AS height", "3 AS channels", "cast(repeat('a', 30000) AS binary) AS data", "true AS decodable")
    boxes = spark.createDataFrame([], "width int, height int, x int, y int, w int, h int")
    for made in (P.picture_codes, P.pixel_sums, lambda f: P.processed(f, boxes), lambda f: P.view_rows(f, number=1, train=False, seed=1)):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        made(shown)
        sizes = [r.n for r in shown.mapInArrow(batch_bytes, "n long").collect()]
        assert len(sizes) > 1 and max(sizes) < 2 * BATCH_BYTES


def test_pictures_are_made_three_times_for_boxes_and_crops(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    shown = spark.range(0, 80, 1, 2).selectExpr("cast(id AS string) AS path", "20 AS width", "20 AS height", "3 AS channels", "unhex(repeat(hex(40 + 4 * (id % 40)), 1200)) AS data", "true AS decodable")
    shown = shown.mapInArrow(counted, shown.schema)
    boxes = P.overlay_free_boxes(shown, pad=0).where("reason = 'ok'").select("width", "height", "x", "y", "w", "h")
    rows = P.processed(shown, boxes, size=8, contrast=None).collect()
    assert len(rows) == 80 and all(r.written and r.boxed and len(r.data) == 192 for r in rows)
    assert made.value == 3 * 80


def test_pictures_need_no_pandas_in_workers(spark, tmp_path):
    import subprocess
    import sys

    script = "import sys; import sieveline.plans.picturing, sieveline.sources.pictures; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", script]).returncode == 0
