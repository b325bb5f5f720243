"""Statistical tests and aggregation functions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.dist import incomplete_beta, kolmogorov_two_sided, normal_quantile, normal_two_sided, t_quantile, t_upper_tail, wilcoxon_exact
from sieveline.operators.metrics import midranks
from sieveline.operators.order import running
from sieveline.sources.scratch import materialise


def placements(df: DataFrame, score: Column, y: Column, id_col: str) -> DataFrame:
    """(id, y, v): for a positive the share of negatives it outscores, for a
    negative the share of positives that outscore it; ties half.

    Running counts go over distinct scores, then rows look their score up.
    """
    rows = df.select(F.col(id_col).alias("id"), y.alias("y"), score.alias("s"))
    table = rows.groupBy("s").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    names = {"upto_pos": "cp", "upto_neg": "cn", "all_pos": "m", "all_neg": "n"}
    table = running(table, [], "s", ["pos", "neg"]).withColumnsRenamed(names)
    up = (F.col("cn") - F.col("neg") / 2) / F.col("n")
    down = (F.col("m") - F.col("cp") + F.col("pos") / 2) / F.col("m")
    return rows.join(table, "s").select("id", "y", F.when(F.col("y") == 1, up).otherwise(down).alias("v"))


def delong(df: DataFrame, a: Column, b: Column, y: Column, id_col: str) -> DataFrame:
    """One row: both AUCs, their difference's variance, z and two-sided p.

    The variance adds the sample covariances of the placements over positives
    and over negatives.  Without variance z is 0 and p is 1.
    """
    x, w = placements(df, a, y, id_col), placements(df, b, y, id_col)
    both = x.select("id", "y", F.col("v").alias("a")).join(w.select("id", F.col("v").alias("b")), "id")
    g = both.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_samp("a").alias("vaa"), F.var_samp("b").alias("vbb"), F.covar_samp("a", "b").alias("vab"))
    pos = lambda c: F.max(F.when(F.col("y") == 1, F.col(c)))
    out = g.agg(pos("ma").alias("auc_a"), pos("mb").alias("auc_b"), F.sum((F.col("vaa") + F.col("vbb") - 2 * F.col("vab")) / F.col("n")).alias("var"), F.sum(F.col("vaa") / F.col("n")).alias("var_a"), F.sum(F.col("vbb") / F.col("n")).alias("var_b"))
    z = F.when(F.col("var") > 0, (F.col("auc_a") - F.col("auc_b")) / F.sqrt("var")).otherwise(F.lit(0.0))
    return out.select("auc_a", "auc_b", (F.col("auc_a") - F.col("auc_b")).alias("auc_diff"), "var", "var_a", "var_b", z.alias("z"))


def with_normal_p(row: DataFrame, z: str = "z") -> DataFrame:
    """A one-row result with its two-sided normal ``p_value``; one number is worked out on the driver."""
    value = row.first()[z]
    return row.withColumn("p_value", F.lit(normal_two_sided(value) if value else 1.0))


def delong_interval(row: DataFrame, level: float = 0.95) -> DataFrame:
    """AUC a with its interval, clipped to [0, 1]."""
    q = normal_quantile((1 + level) / 2)
    half = q * F.sqrt("var_a")
    return row.select("auc_a", F.greatest(F.lit(0.0), F.col("auc_a") - half).alias("ci_lo"), F.least(F.lit(1.0), F.col("auc_a") + half).alias("ci_hi"))


def holm(df: DataFrame, p: str, *, alpha: float = 0.05, by: Sequence[str] = (), tie: str) -> DataFrame:
    """``p_holm`` = min(1, running max of (k - i) * p) and ``significant``."""
    part = Window.partitionBy(*by)
    order = part.orderBy(p, tie)
    ranked = df.withColumn("__i", F.row_number().over(order) - 1).withColumn("__k", F.count(F.lit(1)).over(part))
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranked.withColumn("p_holm", F.least(F.lit(1.0), F.max((F.col("__k") - F.col("__i")) * F.col(p)).over(run)))
    return out.withColumn("significant", F.col("p_holm") < alpha).drop("__i", "__k")


def paired_differences(df: DataFrame, *, unit: str, arm: str, value: str, reference: str) -> DataFrame:
    """(arm, unit, d): each arm's mean minus the reference's, unit by unit."""
    means = df.groupBy(unit, arm).agg(F.avg(value).alias("__m")).where("__m IS NOT NULL AND NOT isnan(__m)")
    ref = means.where(F.col(arm) == reference).select(unit, F.col("__m").alias("__ref"))
    return means.where(F.col(arm) != reference).join(ref, unit).select(arm, unit, (F.col("__ref") - F.col("__m")).alias("d"))


def signed_rank(diffs: DataFrame, arm: str) -> DataFrame:
    """(arm, n, w_plus, w_minus, statistic, mean_delta, cohens_dz); zero differences are left out of the ranks."""
    moved = diffs.where("abs(d) > 1e-12")
    ranked = midranks(moved, F.round(F.abs("d"), 9), [arm])
    sums = ranked.groupBy(arm).agg(F.sum(F.when(F.col("d") > 0, F.col("midrank")).otherwise(0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("midrank")).otherwise(0)).alias("w_minus"), F.array_sort(F.collect_list("midrank")).alias("ranks"))
    facts = diffs.groupBy(arm).agg(F.count("d").alias("n"), F.avg("d").alias("mean_delta"), (F.avg("d") / (F.coalesce(F.stddev_samp("d"), F.lit(0.0)) + 1e-12)).alias("cohens_dz"))
    out = facts.join(sums, arm, "left")
    w = [F.coalesce(c, F.lit(0.0)) for c in ("w_plus", "w_minus")]
    return out.select(arm, "n", w[0].alias("w_plus"), w[1].alias("w_minus"), F.least(*w).alias("statistic"), "mean_delta", "cohens_dz", F.coalesce("ranks", F.array().cast("array<double>")).alias("ranks"))


def wilcoxon(df: DataFrame, *, unit: str, arm: str, value: str, reference: str, alpha: float = 0.05) -> DataFrame:
    """Signed-rank tests of each arm against the reference, Holm adjusted.

    Fewer than three pairs, or no difference, give p = 1.  The exact p-values
    of the few arms are counted on the driver.
    """
    rows = signed_rank(paired_differences(df, unit=unit, arm=arm, value=value, reference=reference), arm).collect()
    made = [(r[arm], r["n"], r["statistic"], 1.0 if r["n"] < 3 or not r["ranks"] else wilcoxon_exact(list(r["ranks"]), r["statistic"]), r["mean_delta"], r["cohens_dz"]) for r in rows]
    table = df.sparkSession.createDataFrame(made, f"{arm} string, n long, statistic double, p_raw double, mean_delta double, cohens_dz double")
    return holm(table, "p_raw", alpha=alpha, tie=arm)


def significance(df: DataFrame, *, unit: str, arm: str, metrics: dict[str, bool], reference: str, alpha: float = 0.05) -> DataFrame:
    """(metric, arm, n, statistic, p_raw, p_holm, significant, mean_delta, cohens_dz, is_strongest):
    the reference against every other arm, for each of ``metrics`` (True: less is better).

    Holm adjusts within a metric.  ``is_strongest`` marks the arm with the best
    mean of the metric among the others, the first by name if equal.  A metric
    that ``df`` lacks, or that no pair has, gives no row.
    """
    metrics = {m: low for m, low in metrics.items() if m in df.columns}
    means = [F.avg(F.when(~F.isnan(F.col(m).cast("double")), F.col(m))).alias(m) for m in metrics]
    runs = materialise(df.groupBy(arm, unit).agg(F.count(F.lit(1)).alias("__n"), *means), "runs")
    out = None
    for m, low in metrics.items():
        tested = wilcoxon(runs, unit=unit, arm=arm, value=m, reference=reference, alpha=alpha)
        best = (F.min if low else F.max)("__mean")
        others = runs.where(F.col(arm) != reference).groupBy(F.col(arm).alias("__arm")).agg(F.avg(m).alias("__mean")).where("__mean IS NOT NULL")
        top = others.agg(best.alias("__best"))
        strongest = others.join(F.broadcast(top), F.col("__mean") == F.col("__best")).agg(F.min("__arm").alias("__strongest"))  # one row
        one = tested.crossJoin(F.broadcast(strongest)).select(F.lit(m).alias("metric"), *tested.columns, F.coalesce(F.col(arm) == F.col("__strongest"), F.lit(False)).alias("is_strongest"))
        out = one if out is None else out.unionByName(one)
    return out


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def mean_std_ci(df: DataFrame, by: Sequence[str], metrics: Sequence[str], *, level: float = 0.95, most_n: int = 64) -> DataFrame:
    """mean, std (0 for one value), t interval and text for each metric; null keys are groups.

    The t quantiles up to ``most_n`` values are a small constant table; beyond,
    the normal quantile corrected by its first two terms in 1/df is used.
    """
    aggs = [F.count(F.lit(1)).alias("n_seeds")]
    for m in metrics:
        v = finite(F.col(m).cast("double"))
        aggs += [F.count(v).alias(f"__n_{m}"), F.avg(v).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(v), F.when(F.count(v) > 0, 0.0)).alias(f"{m}_std")]
    out = df.groupBy(*by).agg(*aggs)
    q = (1 + level) / 2
    z = normal_quantile(q)
    table = F.array(*[F.lit(t_quantile(q, k)) for k in range(1, most_n)])
    for m in metrics:
        n = F.col(f"__n_{m}")
        d = n - 1
        tq = F.when(n <= 1, 0.0).when(n <= most_n, F.get(table, (n - 2).cast("int"))).otherwise(z + (z**3 + z) / (4 * d) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * d * d))
        half = tq * F.col(f"{m}_std") / F.sqrt(F.greatest(n, F.lit(1)))
        out = out.withColumn(f"{m}_ci_lo", F.col(f"{m}_mean") - half).withColumn(f"{m}_ci_hi", F.col(f"{m}_mean") + half)
        out = out.withColumn(f"{m}_str", F.coalesce(F.format_string("%.4f ± %.4f", f"{m}_mean", f"{m}_std"), F.lit("n/a")))
        out = out.withColumn(f"{m}_str", F.when(F.col(f"{m}_mean").isNull(), "n/a").otherwise(F.col(f"{m}_str"))).drop(f"__n_{m}")
    return out


def stars(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), "n/a").when(p < 1e-3, "***").when(p < 1e-2, "**").when(p < 0.05, "*").otherwise("ns")


def one_sample_t(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by…, n, mean, sd, t): against 0; null t unless n > 2 and sd > 0."""
    g = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return g.withColumn("t", F.when((F.col("n") > 2) & (F.col("sd") > 0), F.col("mean") / (F.col("sd") / F.sqrt("n"))))


def with_t_p(table: DataFrame) -> DataFrame:
    """``p_greater`` of a small table of t statistics, worked out in batches."""

    @F.pandas_udf("double")
    def tail(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else t_upper_tail(float(x), float(k) - 1) for x, k in zip(t, n)], dtype="float64")

    return table.withColumn("p_greater", tail("t", "n"))


def linear_fit(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """slope, intercept, r, standard error of the slope, n; finite pairs only."""
    rows = df.select(finite(x).alias("x"), finite(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    g = rows.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.corr("y", "x").alias("r"), F.count(F.lit(1)).alias("n"))
    se = F.when((F.col("n") > 2) & (F.col("r") != 0), F.abs("slope") * F.sqrt((1 / (F.col("r") * F.col("r")) - 1) / (F.col("n") - 2)))
    return g.withColumn("stderr", se)


def slope_p(row: DataFrame) -> float:
    """Two-sided p of a fitted slope."""
    r = row.first()
    t = r["slope"] / r["stderr"] if r["stderr"] else 0.0
    df = r["n"] - 2
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 else 1.0


def spearman(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """One row: the correlation of mid-ranks."""
    rows = df.select(x.alias("x"), y.alias("y"))
    a = midranks(rows, F.col("x")).withColumnRenamed("midrank", "rx")
    return midranks(a, F.col("y")).agg(F.round(F.corr("rx", "midrank"), 9).alias("rho"), F.count(F.lit(1)).alias("n"))


def rank_shift(df: DataFrame, name: str, before: str, after: str) -> DataFrame:
    """Descending average ranks under two protocols and their difference."""
    a = midranks(df.select(name, before, after), F.col(before), descending=True).withColumnRenamed("midrank", "rank_before")
    b = midranks(a, F.col(after), descending=True).withColumnRenamed("midrank", "rank_after")
    return b.select(name, "rank_before", "rank_after", (F.col("rank_before") - F.col("rank_after")).alias("shift"))


def ks_statistic(df: DataFrame, value: Column, sample: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by…, d, n, m): greatest gap between the empirical distributions of sample 1 and 0."""
    rows = df.select(*by, value.alias("v"), sample.alias("g")).groupBy(*by, "v").agg(F.count_if(F.col("g") == 1).alias("a"), F.count_if(F.col("g") == 0).alias("b"))
    rows = running(rows, by, "v", ["a", "b"]).withColumnsRenamed({"upto_a": "ca", "upto_b": "cb", "all_a": "n", "all_b": "m"})
    return rows.groupBy(*by).agg(F.round(F.max(F.abs(F.try_divide("ca", "n") - F.try_divide("cb", "m"))), 9).alias("d"), F.max("n").alias("n"), F.max("m").alias("m"))


def ks_fraction(table: DataFrame, alpha: float = 0.01) -> float:
    """Share of dimensions rejected at alpha over their number; the table has a row for each dimension."""
    rows = table.collect()
    return sum(kolmogorov_two_sided(r["d"], r["n"], r["m"]) < alpha / len(rows) for r in rows) / len(rows) if rows else 0.0


def interpolate(points: DataFrame, *, grid: int = 101) -> DataFrame:
    """(x, y): a curve (fpr, tpr) read linearly at ``grid`` even places in [0, 1].

    The first point is (0, 0).  At a vertical step the upper end counts.
    """
    step = points.groupBy(F.col("fpr").alias("x")).agg(F.min("tpr").alias("lo"), F.max("tpr").alias("hi"))
    order = Window.orderBy("x")
    seg = step.select("x", "hi", F.lead("x").over(order).alias("x1"), F.lead("lo").over(order).alias("y1"))
    g = points.sparkSession.range(grid).select((F.col("id") / (grid - 1)).alias("g"))
    joined = F.broadcast(g).join(seg, (F.col("g") >= F.col("x")) & (F.col("x1").isNull() | (F.col("g") < F.col("x1"))))  # a row for each place
    y = F.when(F.col("x1").isNull(), F.col("hi")).otherwise(F.col("hi") + (F.col("y1") - F.col("hi")) * (F.col("g") - F.col("x")) / (F.col("x1") - F.col("x")))
    return joined.select(F.round("g", 9).alias("x"), F.round(y, 9).alias("y"))


class _Tree:
    """Counts of positives and negatives in a binary tree over ranges of scores, drawn anew for all replicates.

    A node's rows are dealt to its halves binomially, seeded by the node, so
    every task that passes a node draws the same; together that is a multinomial
    draw over the ranges.
    """

    def __init__(self, totals: np.ndarray, replicates: int, seed: int) -> None:
        levels = [totals]
        while len(levels[0]) > 1:
            levels.insert(0, levels[0][::2] + levels[0][1::2])
        self.levels, self.replicates, self.seed = levels, replicates, seed

    def drawn(self, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows in ranges before, rows in the range), each (replicates, 2)."""
        here = np.tile(self.levels[0][0], (self.replicates, 1))
        before = np.zeros_like(here)
        for depth in range(1, len(self.levels)):
            node = leaf >> (len(self.levels) - 1 - depth)
            left, both = self.levels[depth][node & ~1], self.levels[depth - 1][node >> 1]
            r = np.random.default_rng([self.seed, depth, node >> 1])
            gone = r.binomial(here, np.divide(left, both, out=np.zeros(2), where=both > 0))
            if node & 1:
                before, here = before + gone, here - gone
            else:
                here = gone
        return before, here


def bootstrap_band(df: DataFrame, score: Column, y: Column, *, replicates: int = 2000, grid: int = 101, leaf: int = 4096, seed: int = 0) -> DataFrame:
    """(x, tpr, lo, mid, hi): the ROC curve and 2.5, 50 and 97.5 per cent of curves of
    rows redrawn within each class.

    Scores are taken as they are.  They are dealt to ranges of about ``leaf``
    different ones (2^14 ranges at most), and only the ranges' totals reach the
    driver.  A replicate's counts are split down a tree of ranges; a task draws
    the scores of its range only for replicates in which one of the ``grid``
    places falls into it.  Rows without a score or of another class than 0 and 1
    are left out; without rows of both classes there is no curve.
    """
    rows = df.select(score.cast("double").alias("s"), y.alias("y")).where("s IS NOT NULL AND y IN (0, 1)")
    table = materialise(rows.groupBy("s").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")), "scores")
    ranges = 1 << min(14, max(0, int(np.ceil(np.log2(max(1, table.count()) / leaf)))))
    table = materialise(table.repartitionByRange(ranges, F.desc("s")).withColumn("leaf", F.spark_partition_id()), "scores")
    totals = np.zeros((ranges, 2), np.int64)
    for part in table.groupBy("leaf").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect():  # a row for each range
        totals[part["leaf"]] = part["pos"], part["neg"]
    whole = totals.sum(axis=0)
    schema = "b int, x int, tpr double"
    if not whole.all():
        return df.sparkSession.createDataFrame([], "x double, tpr double, lo double, mid double, hi double")
    shared = df.sparkSession.sparkContext.broadcast(totals)  # 16 bytes a range, 2^14 ranges at most
    places = np.linspace(0, 1, grid)

    def curves(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("s", ascending=False)
        own, number = frame[["pos", "neg"]].to_numpy(np.int64), int(frame["leaf"].iloc[0])
        before, here = _Tree(shared.value, replicates, seed).drawn(number)
        # The last row stands for the rows as they are.
        before = np.vstack([before, shared.value[:number].sum(axis=0)])
        here = np.vstack([here, own.sum(axis=0)])
        first = np.searchsorted(places, before[:, 1] / whole[1], "left")
        end = (before + here)[:, 1] / whole[1]
        last = np.where(end < 1, np.searchsorted(places, end, "left"), grid)
        last = np.where(here[:, 1] > 0, last, first)
        share = own / np.maximum(own.sum(axis=0), 1)
        out = {"b": [], "x": [], "tpr": []}
        for b in np.flatnonzero(first < last):
            drawn = own
            if b < replicates:
                r = np.random.default_rng([seed, 64, number, b])
                drawn = np.stack([r.multinomial(here[b, c], share[:, c]) if here[b, c] else np.zeros(len(own), np.int64) for c in (0, 1)], axis=1)
            rates = (before[b] + np.vstack([np.zeros((1, 2), np.int64), np.cumsum(drawn, axis=0)])) / whole
            k = np.arange(first[b], last[b])
            out["b"].append(np.full(len(k), b))
            out["x"].append(k)
            out["tpr"].append(np.interp(places[k], rates[:, 1], rates[:, 0]))
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0) for c, v in out.items()}).astype({"b": "int32", "x": "int32"})

    points = table.groupBy("leaf").applyInPandas(curves, schema)
    redrawn = F.when(F.col("b") < replicates, F.col("tpr"))
    q = lambda p: F.round(F.percentile(redrawn, p), 9)
    real = F.round(F.max(F.when(F.col("b") == replicates, F.col("tpr"))), 9)
    out = points.groupBy("x").agg(real.alias("tpr"), q(0.025).alias("lo"), q(0.5).alias("mid"), q(0.975).alias("hi"))
    return out.withColumn("x", F.round(F.col("x") / (grid - 1), 9))
