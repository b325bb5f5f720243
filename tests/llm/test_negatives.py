"""Hard negatives against all inner products, on odd rows, and what the bounds spare."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from sieveline.llm import negatives
from sieveline.llm.negatives import Finds, hard_negatives, products

SCHEMA = "vec_id long, embedding array<double>, label string, norm double, extra int"


def plain(rows, positives=5, negatives_=10, low=30, high=90):
    """All products, in Python integers."""
    ok = [(n, r) for n, r in enumerate(rows) if r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    vectors = {n: [math.floor(256 * x) for x in r[1]] for n, r in ok}
    place = lambda r: (r[0] is None, r[0] or 0)
    out = []
    for n, a in ok:
        if a[0] is None or a[0] % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vectors[n], vectors[m])), place(c), m, c) for m, c in ok if m != n)
        for score, _, _, p in [x for x in scored if x[3][2] == a[2]][:positives]:
            fit = [x for x in scored if x[3][2] != a[2] and low * -score <= -100 * x[0] <= high * -score]
            out += [(a[0], p[0], k, c[0], -score, -s) for k, (s, _, _, c) in enumerate(fit[:negatives_], 1)]
    return sorted(out, key=repr)


def found(spark, rows, **more):
    out = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, **more)
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_products(spark, monkeypatch, seed):
    """Small buckets and runs, norms from 0 to 8, ties and hot copies of a vector."""
    monkeypatch.setattr(negatives, "BUCKET", 16)
    monkeypatch.setattr(negatives, "RUN", 48)
    monkeypatch.setattr(negatives, "BLOCK", 2)
    r = random.Random(seed)
    hot = [r.uniform(-1, 1) for _ in range(6)]
    rows = []
    for k in range(500):
        size = r.choice([0, 0.2, 1, 8])
        vector = hot if r.random() < 0.3 else [size * r.gauss(0.2, 1) for _ in range(6)]
        rows.append((k, vector, r.choice("aab"), 0.0, k))
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    v = [0.5, 0.25, 1.0]
    rows = [
        (0, v, "a", None, 1), (0, v, "a", None, 1),  # repeated anchor
        (1, v, "a", None, 1), (1, v, "a", None, 1), (None, v, "a", None, None),
        (2, None, "a", None, 1), (3, [None, 1.0, 1.0], "b", None, 1), (4, [math.nan, 1.0, 1.0], "b", None, 1), (5, [math.inf, 1.0, 1.0], "b", None, 1), (6, v, None, None, 1),
        (100, [0.5], "b", None, 1), (7, [], "b", None, 1), (None, [0.4, 0.2, 0.5], "b", None, 1), (8, [0.4, 0.2, 0.5], "b", None, 1), (200, [0.0, 0.0], "c", None, 1),
    ]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
    assert found(spark, rows[:2]) == []  # no other label


def test_products_are_exact():
    import numpy as np

    a = np.array([[2.0**40 + 1, 3.0], [-(2.0**70), 0.0]])
    b = np.array([[2.0**20 + 1, 5.0], [2.0**70, 1.0]])
    assert products(a, b).tolist() == [[(2**40 + 1) * (2**20 + 1) + 15, (1 << 63) - 1], [-(1 << 63), -(1 << 63)]]


def test_bounds_spare_small_norms():
    """A bucket that can't reach a window's lower limit isn't multiplied."""
    import numpy as np

    block = {"a_row": [0], "a_label": ["a"], "a_norm": [10.0], "a_dim": [1], "a_data": [np.array([10.0]).tobytes()], "w_anchor": [0], "w_key": [0], "w_low": [200], "w_high": [10**6], "w_kth": [-(1 << 63)]}
    finds = Finds(block, 1, same=False)
    bucket = {"top": 19.0, "row0": 5, "ids": [1], "labels": ["b"], "dim": 1, "kind": "<i2", "data": None}  # no data to read
    finds.visit(bucket)
    assert not len(finds.window)
    finds.visit(bucket | {"top": 30.0, "data": np.array([30], "<i2").tobytes()})
    assert finds.score.tolist() == [300] and finds.kth.tolist() == [300]
    finds.visit(bucket | {"top": 29.0})  # below the running score
