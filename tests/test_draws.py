"""Interleaved draws against lists, bootstrap bands against redrawn rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveline.operators import partition as P
from sieveline.operators import stats as S

MASK = 2**64 - 1


def plain_place(place: int, n: int, key: int) -> int:
    """One place of the permutation, in whole numbers of Python."""

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
        return x ^ (x >> 31)

    half = (max(1, (n - 1).bit_length()) + 1) // 2
    while True:
        left, right = place >> half, place & ((1 << half) - 1)
        for r in range(1, 9):
            left, right = right, left ^ (mixed((right + key + r * 0x9E3779B97F4A7C15) & MASK) & ((1 << half) - 1))
        place = (left << half) | right
        if place < n:
            return place


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4096, 4097])
def test_places_are_permuted(n):
    for key in (0, 7, 2**62 + 12345):
        got = P.shuffled_places(np.arange(n), np.full(n, n), np.full(n, key))
        assert sorted(got) == list(range(n))
        assert list(got[:50]) == [plain_place(i, n, key) for i in range(min(n, 50))]


def test_large_places():
    n = 2**53 + 3
    places = np.array([0, 1, n - 1, n // 2])
    got = P.shuffled_places(places, np.full(4, n), np.full(4, 99))
    assert list(got) == [plain_place(int(i), n, 99) for i in places]


def test_shuffles_are_spread():
    n = 5000
    got = P.shuffled_places(np.arange(n), np.full(n, n), np.full(n, 5))
    assert abs(np.corrcoef(np.arange(n), got)[0, 1]) < 0.05
    assert np.abs(np.bincount(got[:1000] // 500, minlength=10) - 100).max() < 40


def listed(ids: list[int], key: int, shares) -> list[list[int]]:
    """Clients' ids of one class, in the way of lists: shuffle, then split."""
    order = [None] * len(ids)
    for i, x in enumerate(ids):
        order[plain_place(i, len(ids), key)] = x
    ends = [int(c) for c in np.cumsum(shares)[:-1] * len(ids)]
    return [order[a:b] for a, b in zip([0, *ends], [*ends, len(ids)])]


def labelled(spark, n: int, seed: int):
    r = np.random.default_rng(seed)
    ids, labels = r.permutation(10 * n)[:n], r.choice([0, 1, 3], n, p=[0.7, 0.2, 0.1])
    rows = [(int(a), int(b)) for a, b in zip(ids, labels)]
    return rows, spark.createDataFrame(rows, "id long, y int")


def clients_of(df) -> dict:
    return {r["id"]: r["client"] for r in df.collect()}


@pytest.mark.parametrize("alpha", [0.1, 1.0])
def test_interleaved_partition_equals_lists(spark, alpha):
    rows, df = labelled(spark, 700, 1)
    stream, want = P.Stream(9), {}
    for k in range(4):
        ids = sorted(i for i, y in rows if y == k)
        key = stream.shuffle(len(ids))
        for c, own in enumerate(listed(ids, key, stream.shares(5, alpha))):
            want |= dict.fromkeys(own, c)
    got = clients_of(P.interleaved_partition(df, "y", 5, alpha, id_col="id", seed=9))
    assert got == want and len(got) == 700


def test_pairs_share_their_shares(spark):
    (a, train), (b, test) = labelled(spark, 400, 2), labelled(spark, 150, 3)
    stream, want, shares = P.Stream(4), ({}, {}), []
    for k in range(4):
        shares.append(stream.shares(3, 0.5))
        for rows, out in zip((a, b), want):
            ids = sorted(i for i, y in rows if y == k)
            for c, own in enumerate(listed(ids, stream.shuffle(len(ids)), shares[-1])):
                out |= dict.fromkeys(own, c)
    x, y, p = P.interleaved_pair(train, test, "y", 3, 0.5, id_col="id", seed=4)
    assert (clients_of(x), clients_of(y)) == want and np.array_equal(p, np.array(shares))
    _, _, even = P.interleaved_pair(train, test, "y", 3, float("inf"), id_col="id", seed=4)
    assert np.allclose(even, 1 / 3)


def test_infinite_alpha_cuts_all_rows_evenly(spark):
    rows, df = labelled(spark, 103, 5)
    ids = sorted(i for i, _ in rows)
    key, order = P.Stream(1).shuffle(103), [None] * 103
    for i, x in enumerate(ids):
        order[plain_place(i, 103, key)] = x
    want = {int(x): c for c, part in enumerate(np.array_split(order, 4)) for x in part}
    assert clients_of(P.interleaved_partition(df, "y", 4, float("inf"), id_col="id", seed=1)) == want


def test_odd_labels_have_no_client(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, -1), (4, 0)], "id long, y int")
    got = clients_of(P.interleaved_partition(df, "y", 2, 1.0, id_col="id", seed=1))
    assert got[2] is None and got[3] is None and got[1] is not None and got[4] is not None
    assert P.interleaved_partition(df.limit(0), "y", 2, 1.0, id_col="id", seed=1).count() == 0


def plain_band(s, y, replicates: int, grid: int) -> np.ndarray:
    r, out = np.random.default_rng(0), []
    pos, neg = s[y == 1], s[y == 0]
    for b in range(replicates + 1):
        p, n = (pos, neg) if b == replicates else (r.choice(pos, len(pos)), r.choice(neg, len(neg)))
        cut = np.unique(np.r_[p, n])[::-1]
        up = lambda v: np.r_[0, np.searchsorted(np.sort(-v), -cut, "right")] / len(v)
        out.append(np.interp(np.linspace(0, 1, grid), up(n), up(p)))
    out = np.array(out)
    return np.vstack([out[-1], np.percentile(out[:-1], [2.5, 50, 97.5], axis=0)])


@pytest.mark.parametrize(("leaf", "digits"), [(4096, 9), (40, 9), (40, 1)])
def test_band_is_that_of_redrawn_rows(spark, leaf, digits):
    r = np.random.default_rng(7)
    y = (np.arange(600) % 3 == 0).astype(int)
    s = np.round(r.normal(size=600) + y, digits)
    df = spark.createDataFrame(pd.DataFrame({"s": s, "y": y}))
    got = S.bootstrap_band(df, F.col("s"), F.col("y"), replicates=1500, grid=41, leaf=leaf).orderBy("x").toPandas()
    want = plain_band(s, y, 1500, 41)
    assert np.allclose(got["x"], np.linspace(0, 1, 41))
    assert np.abs(got["tpr"] - want[0]).max() < 1e-8
    for c, w in zip(("lo", "mid", "hi"), want[1:]):
        assert np.abs(got[c] - w).max() < 0.03, c
    assert np.abs(got["hi"] - got["lo"] - want[3] + want[1]).mean() < 0.006


def test_ranges_together_are_one_draw():
    totals = np.random.default_rng(1).integers(0, 50, (16, 2))
    totals[3] = 0
    tree = S._Tree(totals, 4000, 5)
    before, here = zip(*[tree.drawn(k) for k in range(16)])
    assert (np.sum(here, axis=0) == totals.sum(axis=0)).all()
    assert all((before[k] == np.sum(here[:k], axis=0)).all() for k in range(1, 16))
    share = totals / totals.sum(axis=0)
    assert np.abs(np.mean(here, axis=1) - totals).max() < 0.6
    assert np.abs(np.var(here, axis=1) - totals * (1 - share)).max() < 5


def test_no_band_without_both_classes(spark):
    df = spark.createDataFrame([(0.1, 1), (None, 0)], "s double, y int")
    assert S.bootstrap_band(df, F.col("s"), F.col("y")).count() == 0


def test_subgroups_by_counting(spark):
    from sieveline.operators import metrics as M

    r = np.random.default_rng(3)
    rows = [(float(np.round(r.normal(), 1)), int(y), None if k % 11 == 0 else f"k{k % 3}") for k, y in enumerate(r.integers(0, 2, 200))]
    df = spark.createDataFrame([*rows, (None, 1, "k0"), (0.5, None, "k1")], "s double, y int, k string")
    got = {x["stratum"]: x for x in M.subgroups(df, F.col("s"), F.col("y"), F.col("k"), 0.25).collect()}
    normals = [s for s, y, _ in rows if y == 0]
    for k in (None, "k0", "k1", "k2"):
        own = [s for s, y, of in rows if y == 1 and of == k]
        won = sum((s > n) + (s == n) / 2 for s in own for n in normals)
        missed = sum(s < 0.25 for s in own)
        assert (got[k]["total_samples"], got[k]["false_negatives"], got[k]["false_positives"]) == (len(own), missed, 0)
        assert got[k]["auc"] == pytest.approx(won / len(own) / len(normals), abs=1e-9)
        assert got[k]["sensitivity"] == pytest.approx(1 - missed / len(own)) and got[k]["specificity"] is None
    wrong = sum(s >= 0.25 for s in normals)
    assert (got["Normal"]["total_samples"], got["Normal"]["false_positives"]) == (len(normals), wrong)
    assert got["Normal"]["specificity"] == pytest.approx(1 - wrong / len(normals)) and got["Normal"]["auc"] is None
    assert [x["stratum"] for x in M.subgroups(df.limit(0), F.col("s"), F.col("y"), F.col("k"), 0.0).collect()] == ["Normal"]


def test_significance_marks_the_strongest(spark):
    rows = [(a, u, m + 0.01 * u * k, float(k)) for k, (a, m) in enumerate([("ref", 0.9), ("x", 0.7), ("y", 0.8), ("z", 0.8)]) for u in range(6)]
    df = spark.createDataFrame(rows, "arm string, unit int, auc double, cost double")
    got = S.significance(df, unit="unit", arm="arm", metrics={"auc": False, "cost": True, "gone": False}, reference="ref").collect()
    assert {(r["metric"], r["arm"]): r["is_strongest"] for r in got} == {("auc", "x"): False, ("auc", "y"): False, ("auc", "z"): True, ("cost", "x"): True, ("cost", "y"): False, ("cost", "z"): False}
    assert all(r["p_raw"] == pytest.approx(2 / 64) for r in got if r["metric"] == "cost")
