"""Boxes free of overlays and equalised contrast, against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import images as I
from sieveline.operators import pictures as P
from sieveline.plans import picturing

SCHEMA = "path string, width int, height int, channels int, data binary, decodable boolean"


def element(size):
    """The elliptical element's cells, by its own rows."""
    r = size // 2
    return [(dy, dx) for dy, half in zip(range(-r, r + 1), I.ellipse_runs(size)) for dx in range(-half, half + 1)]


def plain_spread(mask, size, grow):
    out = np.zeros_like(mask)
    for y, x in np.ndindex(*mask.shape):
        cells = [mask[y + dy, x + dx] for dy, dx in element(size) if 0 <= y + dy < mask.shape[0] and 0 <= x + dx < mask.shape[1]]
        out[y, x] = any(cells) if grow else all(cells)
    return out


def plain_component(mask):
    best, seen = [], set()
    for start in zip(*np.nonzero(mask)):
        if start in seen:
            continue
        todo, part = [start], []
        seen.add(start)
        while todo:
            y, x = todo.pop()
            part.append((y, x))
            for n in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if 0 <= n[0] < mask.shape[0] and 0 <= n[1] < mask.shape[1] and mask[n] and n not in seen:
                    seen.add(n)
                    todo.append(n)
        best = part if len(part) > len(best) else best
    out = np.zeros_like(mask)
    for y, x in best:
        out[y, x] = True
    return out


def test_elements_are_ellipses():
    assert I.ellipse_runs(11) == [0, 3, 4, 5, 5, 5, 5, 5, 4, 3, 0]
    assert I.ellipse_runs(9) == [0, 3, 3, 4, 4, 4, 3, 3, 0]


@pytest.mark.parametrize("seed", range(4))
def test_morphology_equals_a_plain_version(seed):
    r = np.random.default_rng(seed)
    mask = r.random((23, 31)) < (0.1, 0.4, 0.6, 0.95)[seed]
    for size, grow in ((11, True), (11, False), (9, True), (9, False)):
        assert (I._spread(mask, size, grow) == plain_spread(mask, size, grow)).all()
    assert (I.largest_component(mask) == plain_component(mask)).all()
    for odd in (np.zeros((3, 4), bool), np.ones((1, 5), bool), np.eye(6, dtype=bool), np.zeros((0, 3), bool)):
        assert (I.largest_component(odd) == plain_component(odd)).all()


def frames(r, n, height, width, kind="fine"):
    """Frames with a varying middle and a fixed sign; ``still`` ones don't vary."""
    out = []
    for k in range(n):
        image = np.zeros((height, width, 3), np.uint8)
        if kind != "still":
            image[12:-12, 14:-10] = r.integers(0, 256, (height - 24, width - 24, 3))
        image[2:6, 3:20] = 255
        fine = kind != "unreadable" or k < 20
        out.append((f"{width}x{height}-{k}", width, height, 3, image.tobytes() if fine else None, fine))
    return out


def test_boxes_equal_a_stack_of_frames(spark, monkeypatch):
    monkeypatch.setattr(P, "BAND", 500)
    monkeypatch.setattr(P, "HELD", 200_000)
    r = np.random.default_rng(5)
    fine = frames(r, 70, 60, 80)
    rows = [*fine, *frames(r, 29, 40, 40), *frames(r, 50, 50, 64, "unreadable"), *frames(r, 31, 45, 70, "still"), ("none", None, None, None, None, False), ("odd", -1, -1, -1, None, False)]
    got = {(x.width, x.height): x for x in P.overlay_free_boxes(spark.createDataFrame(rows, SCHEMA).repartition(9), sample=300).collect()}
    stack = np.stack([I.luminance(np.frombuffer(f[4], np.uint8).reshape(60, 80, 3)) for f in fine]).astype(float)
    mask = stack.std(axis=0) > 9
    for size, grow in ((11, True), (11, False), (9, False), (9, True)):
        mask = plain_spread(mask, size, grow)
    assert tuple(got[80, 60])[2:] == (70, "ok", *I.content_box(plain_component(mask)))
    assert got[80, 60].x >= 14 and got[80, 60].y >= 12
    assert [tuple(got[k])[2:] for k in ((40, 40), (64, 50), (70, 45))] == [(29, "too_few_frames", *[None] * 4), (20, "unreadable", *[None] * 4), (31, "no_content", *[None] * 4)]
    assert len(got) == 4
    assert [x.n for x in P.overlay_free_boxes(spark.createDataFrame(fine, SCHEMA), sample=40).collect()] == [40]
    assert P.overlay_free_boxes(spark.createDataFrame([], SCHEMA)).collect() == []


def plain_equalised(plane, clip, grid):
    """Pixel by pixel, from the tiles of the mirrored plane."""
    (h, w), (down, across) = plane.shape, grid
    th, tw = -(-h // down), -(-w // across)
    big = np.pad(plane, ((0, down * th - h), (0, across * tw - w)), mode="reflect")
    tables = {}
    for i in range(down):
        for j in range(across):
            hist = [0] * 256
            for v in big[i * th : (i + 1) * th, j * tw : (j + 1) * tw].reshape(-1):
                hist[v] += 1
            limit = max(1, int(clip * th * tw / 256))
            cut = sum(max(0, x - limit) for x in hist)
            hist = [min(x, limit) + cut // 256 for x in hist]
            rest = cut % 256
            at = 0
            while rest and at < 256:
                hist[at] += 1
                rest -= 1
                at += max(256 // (cut % 256), 1)
            total, table = 0, []
            for x in hist:
                total += x
                table.append(min(255, round(float(total * np.float32(255 / (th * tw))))))
            tables[i, j] = table
    out = np.zeros_like(plane)
    for y, x in np.ndindex(h, w):
        fy, fx = y / th - 0.5, x / tw - 0.5
        i, j = int(np.floor(fy)), int(np.floor(fx))
        level = 0.0
        for a, wy in ((i, 1 - (fy - i)), (i + 1, fy - i)):
            for b, wx in ((j, 1 - (fx - j)), (j + 1, fx - j)):
                level += wy * wx * tables[min(max(a, 0), down - 1), min(max(b, 0), across - 1)][plane[y, x]]
        out[y, x] = round(level)
    return out


@pytest.mark.parametrize("shape,grid,clip", [((64, 64), (8, 8), 2.0), ((45, 70), (4, 5), 2.0), ((33, 40), (8, 8), 4.0)])
def test_equalised_equals_a_plain_version(shape, grid, clip):
    r = np.random.default_rng(1)
    plane = np.clip(r.normal(90, 25, shape) + np.linspace(0, 60, shape[1]), 0, 255).astype(np.uint8)
    found = I.equalised(plane, clip, grid).astype(int)
    assert np.abs(found - plain_equalised(plane, clip, grid)).max() <= 1  # halves may round either way
    assert (found == plain_equalised(plane, clip, grid)).mean() > 0.99


def test_lightness_alone_changes():
    r = np.random.default_rng(2)
    image = r.integers(0, 256, (40, 40, 3)).astype(np.uint8)
    assert np.abs(I.from_lab(I.to_lab(image)).astype(int) - image).max() <= 1
    gray = np.repeat(r.integers(90, 130, (48, 48, 1)), 3, axis=2).astype(np.uint8)
    out = I.equalised_lightness(gray)
    assert np.ptp(out, axis=2).max() <= 1 and out.std() > 1.3 * gray.std()  # gray stays gray, contrast rises
    assert I.equalised_lightness(image[:3, :2]).shape == (3, 2, 3)
    flat = I.equalised(np.full((16, 16), 7, np.uint8))
    assert len(np.unique(flat)) == 1


def test_picture_queries(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(k, r.normal(0, 1, 64).tolist(), k % 3) for k in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    boxes = {x.width: x for x in picturing.frame_boxes(spark, str(tmp_path)).collect()}
    assert set(boxes) == {96, 104, 112} and all(b.reason == "ok" for b in boxes.values())
    image = picturing.drawn(rows[0][1], 0)
    got = {x.path: x for x in picturing.processed_pictures(spark, str(tmp_path)).collect()}
    one, box = got["00000000.png"], boxes[96]
    crop = I.apply_box(image, (box.x, box.y, box.w, box.h))
    assert one.boxed and (one.cropped_w, one.cropped_h) == (box.w, box.h) and one.residual_before > 0
    import hashlib

    assert one.digest == hashlib.md5(P._resized(I.equalised_lightness(crop), 32).tobytes()).hexdigest()
    assert (got["00000003.png"].written, got["00000003.png"].digest) == (False, None)
    codes = {x.path: x.code for x in picturing.picture_hashes(spark, str(tmp_path)).collect()}
    assert len(codes) == 120 and codes["00000003.png"] == 0 and codes["00000000.png"] == I.perceptual_code(image @ np.array([0.114, 0.587, 0.299]))
    views = picturing.picture_views(spark, str(tmp_path))
    assert views.count() == 360 and views.where(F.col("least") > F.col("most")).count() == 0
