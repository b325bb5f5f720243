"""Operators against hand-made and brute-force values, and queries against their SQL."""

from __future__ import annotations

import glob
import math
import os
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import dist, images
from sieveline.operators import curate, inference, metrics, partition, stats
from sieveline.operators.graph import components
from sieveline.plans import registry
from sieveline.sources import readers

SF = "/root/testdata/sf0.001"


def plain_auc(s, y):
    pos, neg = [a for a, b in zip(s, y) if b == 1], [a for a, b in zip(s, y) if b == 0]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def frame(spark, s, y):
    return spark.createDataFrame([(k, float(a), int(b)) for k, (a, b) in enumerate(zip(s, y))], "id long, s double, y int")


def test_auc_and_its_mirror(spark):
    r = random.Random(1)
    s, y = [r.randrange(20) for _ in range(150)], [r.randrange(2) for _ in range(150)]
    df = frame(spark, s, y)
    a = metrics.auc(df, F.col("s"), F.col("y")).first()[0]
    assert abs(a - plain_auc(s, y)) < 1e-9 and abs(a + metrics.auc(df, -F.col("s"), F.col("y")).first()[0] - 1) < 1e-9
    assert metrics.auc(frame(spark, [1, 2], [1, 1]), F.col("s"), F.col("y")).first()[0] is None
    assert metrics.auc(frame(spark, [5] * 4, [0, 1, 0, 1]), F.col("s"), F.col("y")).first()[0] == 0.5


def test_roc_leaves_out_straight_points(spark):
    df = frame(spark, [9, 8, 7, 6, 5, 4], [1, 1, 0, 0, 1, 0])
    points = sorted((p.fpr, p.tpr) for p in metrics.roc_points(df, F.col("s"), F.col("y")).collect())
    assert points == [(0, 0), (0, 2 / 3), (2 / 3, 2 / 3), (2 / 3, 1), (1, 1)]


def test_bins_use_float_edges(spark):
    conf = [0.0, 0.1, 0.30000000000000004, 0.3, 0.6000000000000001, 1.0]
    df = spark.createDataFrame([(c,) for c in conf], "c double")
    edges = [k * 0.1 for k in range(11)]
    assert [x[0] for x in df.select(metrics.bin_of(F.col("c"))).collect()] == [max(sum(e < c for e in edges) - 1, 0) for c in conf]


def test_midranks_sum(spark):
    df = spark.createDataFrame([(k, k % 7) for k in range(50)], "id int, v int")
    assert metrics.midranks(df, F.col("v")).agg(F.sum("midrank")).first()[0] == 50 * 51 / 2


def test_delong_matches_pairs(spark):
    r = np.random.default_rng(2)
    y = r.integers(0, 2, 60)
    a, b = r.integers(0, 9, 60) + y, r.integers(0, 9, 60)
    df = spark.createDataFrame([(k, float(a[k]), float(b[k]), int(y[k])) for k in range(60)], "id long, a double, b double, y int")
    row = stats.delong(df, F.col("a"), F.col("b"), F.col("y"), "id").first()
    kernel = lambda s: (s[y == 1][:, None] > s[y == 0][None]) + (s[y == 1][:, None] == s[y == 0][None]) / 2
    d10, d01 = kernel(a).mean(1) - kernel(b).mean(1), kernel(a).mean(0) - kernel(b).mean(0)
    assert math.isclose(row["var"], d10.var(ddof=1) / len(d10) + d01.var(ddof=1) / len(d01), rel_tol=1e-9)


def test_holm_by_hand(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "n string, p double")
    got = {r.n: round(r.p_holm, 9) for r in stats.holm(df, "p", tie="n").collect()}
    assert got == {"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.5}


def test_distributions():
    assert abs(dist.normal_two_sided(1.959963984540054) - 0.05) < 1e-12
    assert abs(dist.t_quantile(0.975, 4) - 2.7764451051977987) < 1e-9
    assert abs(dist.t_upper_tail(2.131846786326649, 4) - 0.05) < 1e-9
    assert dist.wilcoxon_exact([1, 2, 3, 4, 5], 0) == 0.0625


def test_wilcoxon_with_zeros(spark):
    rows = [(s, m, float(v)) for m, vs in {"ref": [5, 6, 7, 8, 9], "x": [4, 5, 6, 7, 8.5], "same": [5, 6, 7, 8, 9]}.items() for s, v in enumerate(vs)]
    out = {r.m: r.p_raw for r in stats.wilcoxon(spark.createDataFrame(rows, "u int, m string, v double"), unit="u", arm="m", value="v", reference="ref").collect()}
    assert out == {"x": 0.0625, "same": 1.0}


def test_mean_std_ci_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("b", 2.0), (None, float("inf"))], "g string, v double")
    got = {r.g: r for r in stats.mean_std_ci(df, ["g"], ["v"]).collect()}
    assert (got["a"].n_seeds, got["a"].v_mean, got["a"].v_str) == (3, 2.0, "2.0000 ± 1.4142")
    assert (got["b"].v_std, got["b"].v_ci_lo) == (0.0, 2.0) and got[None].v_str == "n/a"


def test_bands_keep_close_pairs_and_pass_over_large_buckets(spark):
    r = random.Random(3)
    base = [r.getrandbits(63) for _ in range(20)]
    codes = [(k, c) for k, c in enumerate(base)] + [(100 + k, c ^ (1 << (k % 60)) ^ (1 << (k % 50 + 3))) for k, c in enumerate(base)]
    pairs = curate.near_pairs(spark.createDataFrame(codes, "id long, code long")).collect()
    assert {(k, 100 + k) for k in range(20)} <= {(p.a, p.b) for p in pairs}
    same = spark.createDataFrame([(k, 7) for k in range(401)], "id long, code long")
    assert curate.near_pairs(same).count() == 0 and curate.skipped_buckets(same).count() == 4
    assert curate.near_pairs(same.where("id < 400")).count() == 400 * 399 // 2


def test_components_match_search(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 430)]
    root = {x: x for e in edges for x in e}
    for _ in range(500):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {x for x in root if all(x not in e or e[0] == e[1] for e in edges)}
    assert got == {k: v for k, v in root.items() if k not in alone}


def test_verdicts(spark):
    rows = spark.createDataFrame([(0, "x", 10, "b"), (1, "x", 10, "a"), (2, "x", 9, "c"), (3, "x", 1, "d"), (4, "y", 1, "e"), (5, "z", 1, "f")], "id long, label string, area int, name string")
    groups = curate.duplicate_groups(spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "a long, b long"))
    out = {r.id: (r.dup_group, r.dedup_verdict) for r in curate.verdicts(rows, groups, id_col="id", label_col="label", area=F.col("area"), name=F.col("name")).collect()}
    assert out == {0: (0, "dropped_duplicate"), 1: (0, "kept"), 2: (0, "dropped_duplicate"), 3: (1, "dropped_conflict"), 4: (1, "dropped_conflict"), 5: (-1, "kept")}


def test_split_rounds_half_even(spark):
    df = spark.createDataFrame([(f"{c}{k}", c) for c, n in (("a", 5), ("b", 15), ("c", 25)) for k in range(n)], "id string, c string")
    got = {(r.c, r.split): r["count"] for r in partition.stratified_split(df, "c", id_col="id").groupBy("c", "split").count().collect()}
    want = {(c, s): k for c, n in (("a", 5), ("b", 15), ("c", 25)) for s, k in (("test", round(0.2 * n)), ("val", round(0.1 * n)), ("train", n - round(0.2 * n) - round(0.1 * n))) if k}
    assert got == want


def test_shards_tile_and_repair(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(200)], "id long, label int")
    cuts = partition.cut_points(partition.dirichlet_proportions(3, 4, 0.1, 1))
    a = partition.assign_clients(partition.rank_in(df, ["label"], 1, "id"), F.col("label"), cuts).drop("r", "n")
    assert partition.tiling_faults(a, df, "id").count() == 0 and partition.tiling_faults(a.where("id <> 5"), df, "id").count() == 1
    fixed = partition.repair(partition.rank_in(df, ["label"], 1, "id"), "label", cuts, least=12).drop("r", "n")
    assert fixed.count() == 200 and partition.tiling_faults(fixed, df, "id").count() == 0
    assert [r["n"] for r in fixed.groupBy("client").agg(F.count("*").alias("n")).collect() if r["n"] < 12] == []


def test_valid_rows_are_numbered(spark):
    df = spark.createDataFrame([(k * 7 % 101, k) for k in range(101)], "id long, v int")
    got = curate.valid_rows(df, F.col("v") % 2 == 0, "id").orderBy("id").collect()
    assert [r.row_id for r in got] == list(range(51))


def test_images(tmp_path, spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 30, 40) + b"\x01\x01\x11\x00\xff\xd9"
    assert images.jpeg_size(jpeg) == (40, 30) and images.jpeg_size(b"\x89PNG") is None and images.jpeg_size(jpeg[:8]) is None
    for c, files in {"big cat": {"b.jpg": jpeg, "a.jpg": b"junk"}, "dog": {"a.jpg": jpeg}}.items():
        (tmp_path / c).mkdir()
        for n, data in files.items():
            (tmp_path / c / n).write_bytes(data)
    inv = {r.image_id: r for r in readers.image_inventory(spark, str(tmp_path), ["big cat", "dog"], ["dog"]).collect()}
    assert set(inv) == {"big_cat__b.jpg", "big_cat__a.jpg", "dog__a.jpg"}
    assert (inv["big_cat__b.jpg"].width_px, inv["big_cat__a.jpg"].width_px, inv["dog__a.jpg"].binary_label) == (40, -1, 1)
    mask = np.zeros((6, 7), bool)
    mask[1:4, 0:2] = mask[2:4, 3:6] = True
    assert images.inscribed_rectangle(mask)[2:] in ((2, 3), (3, 2))
    d = images.dct_matrix(8)
    np.testing.assert_allclose(d @ d.T, np.eye(8), atol=1e-12)
    g = np.random.default_rng(0).integers(0, 255, (48, 48))
    assert images.perceptual_code(g) == images.perceptual_code(np.kron(g, np.ones((2, 2))))
    pic = np.zeros((20, 20, 3), np.uint8)
    pic[4:16, 3:15] = 200
    assert images.crop_border(pic).shape == (12, 12, 3)
    np.testing.assert_allclose(images.box_mean(np.ones((9, 9)), 3), 1)
    assert zlib.crc32(b"") == 0


def test_files_round_trip(tmp_path, spark):
    df = spark.createDataFrame([(1, float("inf"), None), (2, float("nan"), "x")], "a int, b double, c string")
    readers.write_csv(df, str(tmp_path / "t.csv"))
    back = {r.a: r for r in readers.read_optional(spark, str(tmp_path / "t.csv"), df.schema).collect()}
    assert back[1].b == float("inf") and math.isnan(back[2].b) and readers.read_optional(spark, str(tmp_path / "no.csv"), df.schema) is None
    np.save(tmp_path / "f.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    assert [list(r.value) for r in readers.read_arrays(spark, str(tmp_path / "f.npy")).orderBy("row_id").collect()] == [[0, 1, 2], [3, 4, 5]]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.5f}"
    return "nan" if v is None else str(v)


FAST = "leak_audit roc_points screening_metrics ece reliability_bins subgroup_table coverage_risk delong_cov holm wilcoxon_stat aggregate_mean_std hitl_gate fusion ks_stat cam_border survivor_pick stratified_split payload_bytes".split()


@pytest.mark.parametrize("name", FAST)
def test_query_matches_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    a = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    b = sorted(tuple(plain(v) for _, v in sorted(zip(columns, r))) for r in want.fetchall())
    assert a == b


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 75


def test_drift_check_runs_the_whole_sweep(spark, monkeypatch):
    from sieveline.plans import evaluation as E

    sizes = []
    frame = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(600)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(E, "table", lambda *a: frame)
    monkeypatch.setattr(E.R, "inject_drift", lambda cur, *a, **b: cur)
    monkeypatch.setattr(E.R, "check_drift", lambda ref, cur, _: sizes.append((ref.count(), cur.count())) or (False, 0.0, 0.0))
    assert [r.severity for r in E.drift_check(spark, "").collect()] == [0.0, 0.25, 0.5, 0.75, 1.0]
    assert sizes == [(256, 256)] * 5


def test_gate_joins_no_rows_and_keeps_ties_by_id(spark):
    near = [(k, [0.5 + k % 3 / 10, 0.5 - k % 3 / 10]) for k in range(100)]
    rows = spark.createDataFrame(near, "k long, p array<double>").repartition(3)
    gated = inference.accept(rows, "p", classes=2, id_col="k", coverage=0.5, most_entropy=2.0)
    sure = {k for k, _ in sorted(near, key=lambda r: (-r[1][0], r[0]))[:50]}
    assert {r.k for r in gated.collect() if r.accepted} == sure and gated.count() == 100
    plan = gated._jdf.queryExecution().optimizedPlan().toString()
    assert "k#" not in "".join(line for line in plan.splitlines() if "Join" in line and "__id" in line)


def test_rows_without_a_group_meet_no_null_key(spark):
    rows = spark.range(40).selectExpr("id", "if(id < 2, 'a', 'b') AS label", "id AS area", "cast(id AS string) AS name")
    groups = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (5, 1)], "id long, group_id long")
    judged = curate.verdicts(rows, groups, id_col="id", label_col="label", area=F.col("area"), name=F.col("name"))
    assert {r.id: (r.dup_group, r.dedup_verdict) for r in judged.collect()} == {k: (-1, "kept") for k in range(40)} | {0: (0, "dropped_duplicate"), 1: (0, "kept"), 2: (1, "dropped_duplicate"), 5: (1, "kept")}
    # Whole rows meet others by their id alone: the last join is the only one with all of them.
    joins = [line for line in judged._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in line]
    assert len(joins) == 1 and "group_id" not in joins[0]
