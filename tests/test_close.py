"""Close codes without a cap against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from sieveline.operators import close
from sieveline.operators.graph import components


def codes_of(seed: int) -> np.ndarray:
    """A hot band with many near codes, clouds round some centres, lone codes, repeats."""
    r = np.random.default_rng(seed)
    flip = lambda base, n, most: np.array([base ^ sum(1 << int(i) for i in r.permutation(48)[: r.integers(0, most + 1)]) for _ in range(n)], np.uint64)
    hot = r.integers(0, 1 << 48, 300, dtype=np.uint64)  # the highest band is 0 in all of them
    clouds = [flip(int(x), 40, 7) for x in r.integers(0, 1 << 63, 5, dtype=np.uint64)]
    lone = r.integers(0, 1 << 63, 100, dtype=np.uint64) << np.uint64(1)
    out = np.concatenate([hot, *clouds, flip(0, 300, 4), lone])
    return np.concatenate([out, out[::7], out[:3], out[:3]]).view(np.int64)


def brute(values: list[int], distance: int) -> set:
    pairs = set()
    for i, x in enumerate(values):
        for y in values[i + 1 :]:
            d = (x ^ y) & (2**64 - 1)
            if d.bit_count() <= distance and any((d >> (16 * b)) & 0xFFFF == 0 for b in range(4)):
                pairs.add((x, y))
    return pairs


def roots(n: int, pairs) -> list[int]:
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(x) for x in range(n)]


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(close, "BLOCK", 50)


@pytest.mark.parametrize(("node", "levels"), [(400, 3), (60, 2), (60, 0)])
def test_pairs_equal_all_pairs(spark, node, levels):
    values = codes_of(node + levels)
    df = spark.createDataFrame([(k, int(c)) for k, c in enumerate(values)] + [(9999, None)], "id long, code long")
    got = {tuple(r) for r in close.close_codes(df, node=node, levels=levels, stars=False).collect()}
    assert got == brute(sorted({int(c) for c in values}), 5)


def test_stars_have_the_components_of_all_pairs(spark):
    values = [int(c) for c in codes_of(3)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(values)] + [(9999, None)], "id long, code long")
    links = close.close_links(df, node=60, levels=1)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    place = {}
    for k, c in enumerate(values):
        place.setdefault(c, k)
    pairs = [(place[c], k) for k, c in enumerate(values)] + [(place[x], place[y]) for x, y in brute(sorted(set(values)), 5)]
    assert [got.get(k, k) for k in range(len(values))] == roots(len(values), pairs)
    assert 9999 not in got


def test_no_codes(spark):
    df = spark.createDataFrame([], "id long, code long")
    assert close.close_links(df).count() == 0


def test_parts_cover_all_bits_on_every_level():
    for level in range(close.LEVELS):
        masks = close.part_masks(6, level)
        assert sum(masks) == 2**64 - 1 and all(10 <= m.bit_count() <= 11 for m in masks)
