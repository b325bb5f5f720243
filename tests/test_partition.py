"""Places in classes, repaired shards and drift windows against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.functions.rng import hash_key
from sieveline.operators import inference, partition


def plain_repair(shards, labels, least):
    """The rule on lists of rows."""
    classes = max(labels) + 1
    for mine in range(len(shards)):
        for _ in range(classes):
            held = {labels[i] for i in shards[mine]}
            if len(shards[mine]) >= least and len(held) > 1:
                break
            sizes = [len(s) for s in shards]
            donor = sizes.index(max(sizes))
            if donor == mine or sizes[donor] < 2 * least:
                break
            lacking = sorted(set(range(classes)) - held)
            wanted = lacking[0] if lacking else labels[shards[donor][0]]
            pool = [i for i in shards[donor] if labels[i] == wanted]
            go = pool[: max(4, len(pool) // 8)] or shards[donor][:least]
            shards[donor] = [i for i in shards[donor] if i not in set(go)]
            shards[mine] = shards[mine] + go
    return shards


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 6), st.integers(1, 5), st.integers(0, 10**6), st.integers(1, 20), st.sampled_from([0.02, 0.1, 0.5, float("inf")]))
def test_repair_equals_lists(clients, classes, seed, least, alpha):
    r = np.random.default_rng(seed)
    sizes = r.integers(0, 90, classes)
    sizes[-1] += 1
    cuts = partition.cut_points(partition.dirichlet_proportions(classes, clients, alpha, seed % 1000))
    labels, place, number = [], [], {}
    for k, n in enumerate(sizes):
        for x in range(n):
            number[k, x] = len(labels)
            labels.append(k)
            place.append(x)
    rows = lambda shards: [[number[k, x] for k, a, b in s for x in range(a, b)] for s in shards]
    before = partition.shard_intervals(sizes.tolist(), cuts)
    assert sorted(sum(rows(before), [])) == list(range(len(labels)))
    assert rows(partition.repaired_intervals(before, classes, least)) == plain_repair(rows(before), labels, least)


def test_an_eighth_of_the_donors_rows_moves():
    shards = [[(0, 0, 400), (1, 0, 100)], [(1, 100, 105)]]
    got = partition.repaired_intervals(shards, 2, 12)
    assert got == [[(0, 50, 400), (1, 0, 100)], [(1, 100, 105), (0, 0, 50)]]


def test_places_and_repair_in_spark(spark):
    r = np.random.default_rng(4)
    rows = [(k, int(r.choice(4, p=[0.7, 0.1, 0.1, 0.1])) if k % 50 else None) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, label int").repartition(7)
    ranked = partition.rank_in(df, ["label"], 3, "id")
    got = {x.id: x for x in ranked.collect()}
    order = [x.id for x in df.orderBy(hash_key(3, F.col("id")), "id").collect()]
    labels = dict(rows)
    for k in (None, 0, 1, 2, 3):
        own = [i for i in order if labels[i] == k]
        assert [got[i].r for i in own] == list(range(len(own))) and {got[i].n for i in own} == {len(own)}
    assert ranked.columns == ["id", "label", "r", "n"]
    cuts = partition.cut_points(partition.dirichlet_proportions(4, 5, 0.05, 11))
    fixed = {x.id: x.client for x in partition.repair(ranked, "label", cuts, least=30).collect()}
    by_class = [[i for i in order if labels[i] == k] for k in range(4)]
    shards = partition.shard_intervals([len(c) for c in by_class], cuts)
    whole = plain_repair([[by_class[k][x] for k, a, b in s for x in range(a, b)] for s in shards], [labels[i] if labels[i] is not None else 0 for i in range(600)], 30)
    assert all(fixed[i] == c for c, s in enumerate(whole) for i in s)
    assert all(fixed[i] is None for i in range(0, 600, 50)) and len(fixed) == 600
    assert partition.repair(ranked.limit(0), "label", cuts, least=3).count() == 0
    assert partition.rank_in(df, [], 3, "id").agg(F.max("r"), F.max("n")).first()[:] == (599, 600)


def test_mmd2_takes_gamma_from_the_first_rows(spark):
    r = np.random.default_rng(6)
    x, y = r.normal(0, 1, (40, 3)), r.normal(0.5, 2, (30, 3))
    x[7] = x[3]
    some = np.vstack([x[:10], y[:10]])
    d2 = ((some[:, None] - some[None]) ** 2).sum(-1)
    gamma = 1 / np.median(d2[d2 > 0])
    k = lambda a, b: np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(-1))
    off = lambda a: (k(a, a).sum() - len(a)) / (len(a) * (len(a) - 1))
    frame = lambda a: spark.createDataFrame([(p, v.tolist()) for p, v in reversed(list(enumerate(a)))], "place int, v array<double>")
    found = inference.mmd2(frame(x), frame(y), "v", first=10).first()
    assert found.mmd2 == pytest.approx(off(x) + off(y) - 2 * k(x, y).mean()) and found.gamma == pytest.approx(gamma)
    assert inference.mmd2(frame(x), frame(y[:1]), "v").first()[:] == (None, None)
    with pytest.raises(Exception, match="more than"):
        inference.mmd2(frame(np.zeros((inference.MOST_WINDOW + 2, 1))), frame(y[:, :1]), "v").collect()


def test_window_places(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    got = inference.window_sample(df, "k", 9, 2).orderBy("place").collect()
    assert [x.k for x in got] == [x.k for x in df.orderBy(hash_key(2, F.col("k")), "k").limit(9).collect()] and [x.place for x in got] == list(range(9))
