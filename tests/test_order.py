"""Running sums and places against plain orders."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators.order import placed, running


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, descending):
    r = random.Random(descending)
    values = {g: r.sample(range(-500, 500), n) for g, n in (("a", 400), ("b", 7), (None, 90))}
    rows = [(g, v / 8, r.randrange(5), r.randrange(3)) for g, vs in values.items() for v in vs] + [("c", float("inf"), 2, 1), ("c", 0.0, 1, 1)]
    df = spark.createDataFrame(rows, "g string, s double, p long, q long").repartition(5)
    got = {(x.g, x.s): x for x in running(df, ["g"], "s", ["p", "q"], descending=descending, following=True).collect()}
    assert len(got) == len(rows)
    for g in ("a", "b", "c", None):
        own = sorted([x for x in rows if x[0] == g], key=lambda x: -x[1] if descending else x[1])
        for k, x in enumerate(own):
            y, then = got[g, x[1]], own[k + 1] if k + 1 < len(own) else (None,) * 4
            assert (y.upto_p, y.upto_q, y.all_p) == (sum(z[2] for z in own[: k + 1]), sum(z[3] for z in own[: k + 1]), sum(z[2] for z in own))
            assert (y.next_p, y.next_q) == then[2:]
    assert running(df.limit(0), ["g"], "s", ["p"]).count() == 0
    assert running(df.where("g = 'b'"), [], "s", ["p"]).agg(F.max("upto_p")).first()[0] == sum(x[2] for x in rows if x[0] == "b")


def test_places(spark):
    r = random.Random(4)
    rows = [(k, None if k % 40 == 0 else r.randrange(30) / 7) for k in range(600)]
    got = {x.id: x for x in placed(spark.createDataFrame(rows, "id long, u double").repartition(4), "u", "id").collect()}
    order = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))
    assert [got[k].place for k, _ in order] == list(range(1, 601)) and {x.all for x in got.values()} == {600}


def test_no_task_holds_the_scores(spark):
    """Only windows over ranges have no partition by range."""
    df = spark.range(1000).select((F.col("id") / 7).alias("s"), F.lit(1).alias("p"))
    plan = running(df, [], "s", ["p"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Window")]
    assert windows and all("__range" in w or "__part" in w or "__p#" in w for w in windows)
