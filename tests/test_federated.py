"""Fitting by sums against a plain single-machine version, scoring under heads, adaptation."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import federated as FED
from sieveline.operators.federated import LEARNED, POOLED, FitConfig

CFG = FitConfig(classes=3, hidden=6, rounds=2, epochs=2, dropout=0.25, batches=2, inner=3)


def data(n=90, dim=4, seed=0):
    r = np.random.default_rng(seed)
    y = r.integers(0, 3, n)
    return [(k, int(r.choice(3, p=[0.7, 0.2, 0.1])), (r.normal(size=dim) + 2 * np.eye(dim)[y[k]]).tolist(), int(y[k])) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, c int, v array<double>, y int").repartition(5)


def plain_loss(s, x, y, w, mask):
    z = x @ s["fc1.w"] + s["fc1.b"]
    n = (z - z.mean(0)) / np.sqrt(z.var(0) + 1e-5)
    h = FED.gelu(n * s["bn.g"] + s["bn.b"])[0] * mask
    p = FED.softmax_rows(h @ s["fc2.w"] + s["fc2.b"])
    return -(w[y] * np.log(p[np.arange(len(y)), y])).sum() / w[y].sum()


def plain_gradient(s, x, y, w, mask):
    """Backwards through the whole batch at once."""
    z = x @ s["fc1.w"] + s["fc1.b"]
    sd = np.sqrt(z.var(0) + 1e-5)
    n = (z - z.mean(0)) / sd
    h, slope = FED.gelu(n * s["bn.g"] + s["bn.b"])
    h = h * mask
    d = FED.softmax_rows(h @ s["fc2.w"] + s["fc2.b"])
    d[np.arange(len(y)), y] -= 1
    d *= (w[y] / w[y].sum())[:, None]
    a = (d @ s["fc2.w"].T) * slope * mask
    dn = a * s["bn.g"]
    dz = (dn - dn.mean(0) - n * (dn * n).mean(0)) / sd
    return {"fc2.w": h.T @ d, "fc2.b": d.sum(0), "bn.g": (a * n).sum(0), "bn.b": a.sum(0), "fc1.w": x.T @ dz, "fc1.b": np.zeros(6)}  # dz sums to zero but for rounding, which Adam would blow up


@pytest.mark.parametrize("split", [1, 4])
def test_sums_give_the_gradient(split):
    r = np.random.default_rng(1)
    x, y, w, mask = r.normal(size=(20, 5)), r.integers(0, 3, 20), np.array([1.0, 2.0, 0.5]), r.integers(0, 2, (20, 6)) / 0.5
    s = FED.initial_state(5, CFG)
    s |= {"bn.g": r.normal(1, 0.3, 6), "bn.b": r.normal(0, 0.3, 6)}
    m = FED.Moments.from_flat(sum(FED.Moments.of(p, q, 3) for p, q in zip(np.array_split(x, split), np.array_split(y, split))), 5)
    mu, var = m.norm(s)
    sums = sum(FED.partial_gradient(s, mu, var, p, q, w, k) for p, q, k in zip(*(np.array_split(a, split) for a in (x, y, mask))))
    loss, g = FED.whole_gradient(s, mu, var, m, sums)
    assert loss == pytest.approx(plain_loss(s, x, y, w, mask))
    for k, expected in plain_gradient(s, x, y, w, mask).items():
        assert np.allclose(g[k], expected, atol=1e-9)
        at = tuple(r.integers(0, size) for size in s[k].shape)
        moved = [s | {k: s[k] + e * (np.arange(s[k].size).reshape(s[k].shape) == np.ravel_multi_index(at, s[k].shape))} for e in (1e-6, -1e-6)]
        assert abs((plain_loss(moved[0], x, y, w, mask) - plain_loss(moved[1], x, y, w, mask)) / 2e-6 - g[k][at]) < 1e-5


def plain_train(rows, method, batch_of, hash_of, cfg):
    """One method by loops over clients and batches, rows in memory."""
    clients = sorted({r[1] for r in rows})
    x, y, c = (np.array([r[k] for r in rows]) for k in (2, 3, 1))
    members = {k: np.flatnonzero(c == k) for k in clients} if method != "centralized" else {POOLED: np.arange(len(rows))}
    begin = FED.initial_state(x.shape[1], cfg)
    shared, own, step = FED.copied(begin), {k: FED.copied(begin) for k in members}, 0
    for number in range(1, cfg.rounds + 1):
        at = {k: FED.copied(own[k] if method == "local" else shared | {n: v for n, v in own[k].items() if FED.is_private(n, method, cfg)}) for k in members}
        opt, theta, anchor = {k: FED.Adam(cfg, at[k]) for k in members}, {}, {k: FED.copied(at[k]) for k in members}
        for epoch in range(cfg.epochs):
            for batch in np.random.default_rng([cfg.seed, number, epoch]).permutation(cfg.batches):
                for turn in range(cfg.inner):
                    step += 1
                    for k, of in members.items():
                        if turn and method != "pfedme":
                            continue
                        some = of[batch_of[of] == batch]
                        if len(some) < 2:
                            continue
                        if method == "pfedme" and not turn:
                            theta[k] = (FED.copied(at[k]), FED.Adam(cfg, at[k]))
                        s, adam = theta[k] if method == "pfedme" else (at[k], opt[k])
                        counts = np.bincount(y[of], minlength=cfg.classes)
                        w = FED.class_weights(counts, cfg, method == "fedgim")
                        z = x[some] @ s["fc1.w"] + s["fc1.b"]
                        g = plain_gradient(s, x[some], y[some], w, FED.keep_mask(hash_of[some], cfg.hidden, step, cfg.dropout))
                        s["bn.mean"] = 0.9 * s["bn.mean"] + 0.1 * z.mean(0)
                        s["bn.var"] = 0.9 * s["bn.var"] + 0.1 * z.var(0, ddof=1)
                        if method == "pfedme":
                            g = {n: g[n] + cfg.lam * (s[n] - at[k][n]) for n in LEARNED}
                        elif method in ("fedprox", "fedgim"):
                            g = {n: g[n] + cfg.mu * (s[n] - anchor[k][n]) for n in LEARNED}
                        adam.step(s, g)
                if method == "pfedme":
                    for k in at:
                        if k in theta:
                            at[k] |= {n: v - cfg.outer_lr * cfg.lam * (v - theta[k][0][n]) for n, v in at[k].items() if n != "bn.steps"}
        if method == "centralized":
            shared = at[POOLED]
        elif method != "local":
            n = np.array([len(members[k]) for k in at], float)
            shared |= FED.averaged([at[k] for k in at], n, method, cfg)
        own = {k: theta[k][0] if method == "pfedme" else at[k] for k in at}
    return shared, own


def test_every_method_equals_a_plain_version(spark):
    rows = data()
    df = frame(spark, rows)
    keys = {r.id: r for r in df.select("id", F.pmod(F.xxhash64(F.lit(CFG.seed), "id"), F.lit(2)).alias("b"), F.xxhash64("id").alias("h")).collect()}
    batch_of, hash_of = (np.array([keys[r[0]][k] for r in rows]) for k in ("b", "h"))
    fit, history = FED.train(df, client="c", vector="v", label="y", id_col="id", cfg=CFG, validation=df.where("id % 3 = 0"), abnormal=(0,))
    for method in FED.METHODS:
        shared, own = plain_train(rows, method, batch_of, hash_of, CFG)
        heads = fit.heads(method)
        assert sorted(heads) == ([0, 1, 2] if method in FED.PERSONAL else [POOLED])
        for c, head in heads.items():
            whole = shared if c == POOLED else own[c] if method in ("local", "pfedme") else shared | {k: v for k, v in own[c].items() if FED.is_private(k, method, CFG)}
            for k in (*LEARNED, "bn.mean", "bn.var"):
                assert np.allclose(head[k], whole[k], atol=1e-8), (method, c, k)
    assert [(m, n) for m, n, *_ in history] == [(m, n) for n in (1, 2) for m in FED.METHODS]
    mb = 4 * (4 * 6 + 5 * 6 + 6 * 3 + 3) * 3 * 2 / 2**20
    for m, n, loss, auc, comm, total in history:
        assert loss > 0 and 0 <= auc <= 1
        assert comm == pytest.approx(0 if m in ("centralized", "local") else mb - (4 * 21 * 6 / 2**20 if m in ("fedper", "fedgim") else 0)) and total == pytest.approx(n * comm)
    last = fit.heads("fedavg")[POOLED]
    val = [r for r in rows if r[0] % 3 == 0]
    score = FED.softmax_rows(FED.head_logits(last, np.array([r[2] for r in val])))[:, 0]
    won = [(a > b) + (a == b) / 2 for a, r in zip(score, val) if r[3] == 0 for b, q in zip(score, val) if q[3]]
    assert [a for m, n, _, a, *_ in history if (m, n) == ("fedavg", 2)] == [pytest.approx(np.mean(won), abs=1e-6)]


def test_learning_lowers_the_loss(spark):
    cfg = replace(CFG, hidden=12, rounds=8, lr=2e-2, dropout=0.0)
    _, history = FED.train(frame(spark, data(120)), client="c", vector="v", label="y", id_col="id", methods=("centralized", "fedavg"), cfg=cfg)
    for m in ("centralized", "fedavg"):
        losses = [h[2] for h in history if h[0] == m]
        assert losses[-1] < 0.7 * losses[0]


def test_odd_rows(spark):
    rows = [(1, 0, [1.0, 0.0], 0), (1, 0, [0.0, 1.0], 1), (2, None, [1.0, 1.0], 0), (3, 0, None, 1), (4, 1, [0.5, 0.5], 2), (5, 0, [1.0, 1.0], None), (6, 0, [1.0, 1.0], 9)]
    fit, history = FED.train(frame(spark, rows), client="c", vector="v", label="y", id_col="id", cfg=replace(CFG, rounds=1, inner=1))
    assert fit.clients == [0, 1] and fit.n[POOLED] == 3 and len(history) == 7
    begin = FED.initial_state(2, CFG)
    assert np.allclose(fit.heads("local")[1]["fc1.w"], begin["fc1.w"])  # a batch of one row is passed over
    fit, history = FED.train(frame(spark, []), client="c", vector="v", label="y", id_col="id", cfg=CFG)
    assert history == [] and fit.clients == []
    with pytest.raises(ValueError, match="unknown"):
        FED.train(frame(spark, rows), client="c", vector="v", label="y", id_col="id", methods=("x",))


@pytest.mark.parametrize("at_once", [64_000_000, 1])
def test_scores_under_heads(spark, monkeypatch, at_once):
    """Whether the heads are broadcast together or one by one."""
    monkeypatch.setattr(FED, "STATES_AT_ONCE", at_once)
    r = np.random.default_rng(3)
    heads = {}
    for c in range(3):
        heads[c] = {k: v + r.normal(0, 0.3, v.shape) if v.dtype != np.int64 else v for k, v in FED.initial_state(4, CFG).items()}
        heads[c]["bn.var"] = np.abs(heads[c]["bn.var"])
    rows = [(k, int(k % 4), v, y) for k, (_, _, v, y) in enumerate(data(40))]
    rows[5] = (5, 1, None, 0)
    df = frame(spark, rows)
    p = {c: FED.softmax_rows(FED.head_logits(s, np.array([v if v else [0.0] * 4 for _, _, v, _ in rows]))) for c, s in heads.items()}
    routed = {x.id: x.logp for x in FED.predict_test(df, heads, vector="v", assigned="c").collect()}
    every = {x.id: x.logp for x in FED.predict_test(df, heads, vector="v", mode="ensemble").collect()}
    one = {x.id: x.logp for x in FED.predict_test(df, {POOLED: heads[1]}, vector="v", assigned="c").collect()}
    for k, c, v, _ in rows:
        if v is None:
            assert routed[k] is every[k] is one[k] is None
            continue
        assert routed[k] is None if c == 3 else np.allclose(routed[k], np.log(p[c][k]))
        assert np.allclose(every[k], np.log(sum(q[k] for q in p.values()) / 3)) and np.allclose(one[k], np.log(p[1][k]))
    with pytest.raises(ValueError):
        FED.predict_test(df, heads, vector="v")


def test_adaptation_lowers_entropy(spark):
    r = np.random.default_rng(5)
    s = FED.initial_state(4, CFG) | {"bn.g": r.normal(1, 0.2, 6), "bn.b": r.normal(0, 0.2, 6)}
    x = r.normal(size=(70, 4))
    e, gain, bias = FED.entropy_gradient(s, x)
    for k, g in (("bn.g", gain), ("bn.b", bias)):
        for i in range(6):
            up, down = (FED.entropy_gradient(s | {k: s[k] + h * (np.arange(6) == i)}, x)[0] for h in (1e-6, -1e-6))
            assert abs((up - down) / 2e-6 - g[i]) < 1e-6
    adapted = FED.entropy_adapt(s, x, steps=20, lr=1e-2)
    assert FED.entropy_gradient(adapted, x)[0] < e and np.allclose(adapted["fc1.w"], s["fc1.w"])
    assert np.allclose(FED.entropy_adapt(s, x, steps=1, lr=1e-3)["bn.g"], s["bn.g"] - 1e-3 * np.sign(gain), atol=1e-5)  # Adam's first step
    window = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "place int, v array<double>").repartition(3)
    assert np.allclose(FED.window_adapt(s, window, "v", steps=2)["bn.g"], FED.entropy_adapt(s, x, steps=2)["bn.g"])
    with pytest.raises(ValueError, match="more than"):
        FED.window_adapt(s, window, "v", most=9)
    assert np.allclose(FED.entropy_adapt(s, x[:1])["bn.g"], s["bn.g"])


def test_fixed_forms():
    x = np.linspace(-4, 4, 33)
    assert np.allclose(FED.erf(x), [math.erf(v) for v in x], atol=2e-7)
    w = np.array([[0.5, -1.27]])
    assert np.allclose(FED.quantised(w), w) and FED.quantised(np.zeros(3)).tolist() == [0, 0, 0]
    mask = FED.keep_mask(np.arange(4000), 8, 3, 0.3)
    assert abs((mask > 0).mean() - 0.7) < 0.02 and set(np.unique(mask)) == {0, 1 / 0.7}
    assert (FED.keep_mask(np.array([7, 5]), 8, 3, 0.3)[1] == FED.keep_mask(np.array([5]), 8, 3, 0.3)[0]).all()


def test_rows_are_worked_on_a_few_at_a_time():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + n), pa.int64())], names=["x"]) for k, n in ((0, 1300), (1300, 0), (1300, 512), (1812, 7))]
    parts = list(FED._slices(iter(batches)))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(1819)) and max(map(len, parts)) == FED.ROWS_AT_ONCE


def test_rounds_are_validated_together(spark, monkeypatch):
    df, cfg = frame(spark, data(120)), replace(CFG, rounds=3, inner=1)
    asked, real = [], FED.head_aucs
    monkeypatch.setattr(FED, "head_aucs", lambda rows, heads, abnormal: asked.append(len(heads)) or real(rows, heads, abnormal))

    def run():
        asked.clear()
        return FED.train(df, client="c", vector="v", label="y", id_col="id", methods=("fedavg", "fedper"), cfg=cfg, validation=df.where("id % 3 = 0"), abnormal=(0,))[1]

    together = run()
    assert len(asked) == 1 and [h[1] for h in together] == [1, 1, 2, 2, 3, 3]
    monkeypatch.setattr(FED, "STATES_AT_ONCE", 1)
    apart = run()
    assert len(asked) == 3 and [h[3] for h in apart] == [h[3] for h in together] and len({h[3] for h in together}) > 2
