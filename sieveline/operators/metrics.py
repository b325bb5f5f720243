"""Evaluation metrics as window and aggregate plans.

Ranks and curves start from one row for each distinct score; running sums over
them go by ranges of scores (``operators.order``), so no task holds them all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions import guard
from sieveline.operators.order import placed, running

#: Bin edges as k * (1 / 10), the floats an evenly spaced grid has; never conf * 10.
EDGES = tuple(k * 0.1 for k in range(11))


def score_table(df: DataFrame, score: Column, y: Column, by: Sequence[str] = (), times: Column | None = None) -> DataFrame:
    """(by…, s, pos, neg): positives and negatives at each distinct score; a row counts ``times``."""
    n = F.lit(1).cast("long") if times is None else times
    rows = df.select(*by, score.alias("s"), y.alias("y"), n.alias("times")).where("s IS NOT NULL AND y IS NOT NULL")
    of = lambda value: F.sum(F.when(F.col("y") == value, F.col("times")).otherwise(0))
    return rows.groupBy(*by, "s").agg(of(1).alias("pos"), of(0).alias("neg"))


def midranks(df: DataFrame, value: Column, by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """All rows with ``midrank``: the mean of the 1-based places of equal values."""
    v = df.withColumn("__v", value)
    table = v.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n"))
    table = running(table, by, "__v", ["__n"], descending=descending)
    table = table.select(*by, "__v", (F.col("upto___n") - (F.col("__n") - 1) / 2).alias("midrank"))
    return v.join(table, [*by, "__v"]).drop("__v")


def auc(df: DataFrame, score: Column, y: Column, by: Sequence[str] = (), times: Column | None = None) -> DataFrame:
    """(by…, auc): probability that a positive outscores a negative, ties half; null for one class."""
    table = running(score_table(df, score, y, by, times), by, "s", ["neg"])
    below = F.col("upto_neg") - F.col("neg")
    won = table.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    sums = won.groupBy(*by).agg(F.sum("won").alias("won"), F.sum("pos").alias("m"), F.sum("neg").alias("n"))
    return sums.select(*by, F.round(F.when((F.col("m") > 0) & (F.col("n") > 0), F.col("won") / (F.col("m") * F.col("n"))), 9).alias("auc"))


def roc_points(df: DataFrame, score: Column, y: Column, by: Sequence[str] = (), times: Column | None = None) -> DataFrame:
    """(by…, thr, tp, fp, tpr, fpr): thresholds from high to low, the first infinite;
    interior points of straight stretches are left out."""
    table = score_table(df, score, y, by, times)
    run = running(table, by, "s", ["pos", "neg"], descending=True, following=True)
    # A point stays where the steps before and behind it differ, and at the end.
    bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    kept = run.where(F.coalesce(bend, F.lit(True))).select(*by, F.col("s").alias("thr"), F.col("upto_pos").alias("tp"), F.col("upto_neg").alias("fp"))
    start = table.groupBy(*by).agg(F.lit(float("inf")).alias("thr"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    totals = table.groupBy(*by).agg(F.sum("pos").alias("m"), F.sum("neg").alias("n"))
    points = kept.unionByName(start)
    points = points.join(totals, list(by)) if by else points.crossJoin(F.broadcast(totals))  # one row of totals
    return points.where("m > 0 AND n > 0").select(*by, "thr", "tp", "fp", (F.col("tp") / F.col("m")).alias("tpr"), (F.col("fp") / F.col("n")).alias("fpr"))


def sensitivity_at(points: DataFrame, level: float = 0.9, by: Sequence[str] = ()) -> DataFrame:
    """(by…, sensitivity, specificity, thr): of the points with enough specificity
    the first with the greatest sensitivity; without one, sensitivity 0 at the
    greatest specificity."""
    spec = 1 - F.col("fpr")
    best = F.max(F.when(spec >= level, F.struct(F.col("tpr"), F.col("thr"), spec.alias("spec")))).alias("good")
    most = F.max(F.struct(spec.alias("spec"), F.col("thr"))).alias("most")
    found = points.groupBy(*by).agg(best, most)
    return found.select(
        *by,
        F.coalesce("good.tpr", F.lit(0.0)).alias("sensitivity"),
        F.coalesce("good.spec", "most.spec").alias("specificity"),
        F.coalesce("good.thr", "most.thr").alias("thr"),
    )


def confusion(df: DataFrame, y: Column, pred: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by…, tp, fp, fn, tn)."""
    rows = df.select(*by, y.alias("y"), pred.alias("p"))
    c = lambda a, b: F.count_if((F.col("y") == a) & (F.col("p") == b))
    return rows.groupBy(*by).agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(0, 0).alias("tn"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 with 0 where nothing is predicted or true."""
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def screening(df: DataFrame, score: Column, y: Column, by: Sequence[str] = (), level: float = 0.9) -> DataFrame:
    """(by…, auc, sensitivity, specificity, thr, f1, accuracy) at the operating
    point of ``sensitivity_at``; with one class nulls and threshold 0.5."""
    rows = df.withColumn("__s", score).withColumn("__y", y)
    area = auc(rows, F.col("__s"), F.col("__y"), by)
    at = sensitivity_at(roc_points(rows, F.col("__s"), F.col("__y"), by), level, by)
    facts = guard.join(area, at, by).withColumn("thr", F.coalesce("thr", F.lit(0.5)))
    judged = guard.join(rows, facts.select(*by, F.col("thr").alias("__t")), by)
    c = confusion(judged, F.col("__y"), (F.col("__s") >= F.col("__t")).cast("int"), by)
    c = c.select(*by, f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"), ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"))
    out = guard.join(facts, c, by)
    return out.select(*by, "auc", *[F.round(x, 9).alias(x) for x in ("sensitivity", "specificity", "thr")], *[F.round(F.when(F.col("auc").isNotNull(), F.col(x)), 9).alias(x) for x in ("f1", "accuracy")])


def multiclass(df: DataFrame, y: str, pred: str, classes: Sequence[int]) -> DataFrame:
    """Accuracy, macro F1 and support-weighted F1, from one table of class counts."""
    arr = F.array(*map(F.lit, classes))
    counts = df.groupBy(y, pred).count()  # classes squared
    per = counts.select(F.explode(arr).alias("c"), F.col(y).alias("y"), F.col(pred).alias("p"), "count").groupBy("c").agg(
        F.sum(F.when((F.col("y") == F.col("c")) & (F.col("p") == F.col("c")), F.col("count")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("y") != F.col("c")) & (F.col("p") == F.col("c")), F.col("count")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("y") == F.col("c")) & (F.col("p") != F.col("c")), F.col("count")).otherwise(0)).alias("fn"),
    )
    per = per.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn"))).withColumn("support", F.col("tp") + F.col("fn"))
    seen = (F.col("support") > 0) | (F.col("fp") > 0)  # classes that occur on either side
    return per.agg(
        F.round(F.sum("tp") / F.sum("support"), 9).alias("accuracy"),
        F.round(F.avg(F.when(seen, F.col("f1"))), 9).alias("macro_f1"),
        F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 9).alias("weighted_f1"),
    )


def ovr_auc(df: DataFrame, y: str, p: str, classes: Sequence[int]) -> DataFrame:
    """One-vs-rest AUC of each class and their mean; null if a class is absent."""
    rows = df.select(F.explode(F.array(*map(F.lit, classes))).alias("c"), F.col(y).alias("y"), F.col(p).alias("p"))
    rows = rows.select("c", (F.col("y") == F.col("c")).cast("int").alias("y"), F.get("p", F.col("c")).alias("s"))
    per = auc(rows, F.col("s"), F.col("y"), ["c"])
    whole = per.agg(F.when(F.count("auc") == len(classes), F.avg("auc")).alias("m"))
    return per.select(F.col("c").cast("string").alias("class"), "auc").union(whole.select(F.lit("macro"), F.round("m", 9)))


def bin_of(conf: Column, edges: Sequence[float] = EDGES) -> Column:
    """Zero-based bin of (lo, hi]; 0 belongs to the first bin."""
    return F.greatest(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < conf)) - 1, F.lit(0)).cast("int")


def reliability(df: DataFrame, conf: Column, correct: Column, by: Sequence[str] = ()) -> DataFrame:
    """All bins with count, mean confidence and accuracy; null statistics in empty bins."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(k, EDGES[k], EDGES[k + 1]) for k in range(10)], "bin int, bin_lo double, bin_hi double")
    rows = df.select(*by, conf.alias("conf"), correct.cast("double").alias("ok")).withColumn("bin", bin_of(F.col("conf")))
    stats = rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("avg_conf"), F.avg("ok").alias("accuracy"))
    full = guard.cross(rows.select(*by).distinct() if by else None, bins)
    return full.join(stats, [*by, "bin"], "left").select(*by, "bin", F.round("bin_lo", 9).alias("bin_lo"), F.round("bin_hi", 9).alias("bin_hi"), F.coalesce("n", F.lit(0)).alias("n"), F.round("avg_conf", 9).alias("avg_conf"), F.round("accuracy", 9).alias("accuracy"))


def calibration_error(df: DataFrame, conf: Column, correct: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by…, ece): the count-weighted gap between confidence and accuracy over the bins."""
    rows = df.select(*by, conf.alias("conf"), correct.cast("double").alias("ok")).withColumn("bin", bin_of(F.col("conf")))
    stats = rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("conf") - F.avg("ok")).alias("gap"))
    return stats.groupBy(*by).agg(F.round(F.sum(F.col("gap") * F.col("n")) / F.sum("n"), 9).alias("ece"))


def brier(df: DataFrame, p: Column, y: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.avg(F.pow(p - y, 2)), 9).alias("brier"))


def coverage_risk(df: DataFrame, uncertainty: Column, wrong: Column, missed: Column, *, id_col: str, least: int = 10) -> DataFrame:
    """Error and false-negative rate of the surest k rows for eleven coverages.

    Each row's place is found once; the rows are then counted by the number of
    coverages they miss and summed from there, so nothing is copied 11 times.
    """
    levels = [0.5 + 0.05 * k for k in range(11)]
    rows = df.select(F.col(id_col).alias("id"), uncertainty.alias("u"), wrong.cast("int").alias("wrong"), missed.cast("int").alias("missed"), F.lit(1).alias("one"))
    ranked = placed(rows, "u", "id", "r").withColumnRenamed("all", "n")
    takes = F.array(*[F.greatest(F.lit(least), F.floor(F.lit(round(c, 2)) * F.col("n"))) for c in levels])
    first = ranked.withColumn("level", F.size(F.filter(takes, lambda k: k < F.col("r"))))
    sums = first.groupBy("level").agg(F.sum("one").alias("k"), F.sum("wrong").alias("wrong"), F.sum(F.when(F.col("missed") == 1, 1).otherwise(0)).alias("fn"), F.count_if(F.col("missed").isNotNull()).alias("pos"))
    grid = df.sparkSession.createDataFrame([(k, round(c, 2)) for k, c in enumerate(levels)], "g int, coverage double")
    joined = grid.join(F.broadcast(sums), F.col("level") <= F.col("g"), "left")  # eleven rows each
    return joined.groupBy("coverage").agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("k"),
        F.round(F.sum("wrong") / F.sum("k"), 9).alias("selective_error"),
        F.round(F.sum("fn") / F.greatest(F.sum("pos"), F.lit(1)), 9).alias("selective_fn_rate"),
    )


def selective(df: DataFrame, accepted: str = "accepted") -> DataFrame:
    """The accepted rows, or all rows where none is accepted."""
    some = df.agg(F.coalesce(F.bool_or(accepted), F.lit(False)).alias("__some"))
    return df.crossJoin(F.broadcast(some)).where(F.col(accepted) | ~F.col("__some")).drop("__some")


def waterfall(counts: DataFrame, step: str, order: str, n: str) -> DataFrame:
    """Running totals of removals: start and end of each step's bar; a row for each step."""
    run = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select(step, order, n, (F.sum(n).over(run) - F.col(n)).alias("start"), F.sum(n).over(run).alias("end"))


def subgroups(df: DataFrame, score: Column, y: Column, stratum: Column, threshold: float, normal: str = "Normal") -> DataFrame:
    """(stratum, total_samples, false_negatives, false_positives, auc, sensitivity, specificity).

    Positives (``y`` 1) are told by ``stratum``, each stratum against all
    negatives together, which have the row ``normal``; it has a specificity and
    no sensitivity or AUC, and is there even without a negative.  Negatives are
    counted once, whatever the number of strata.  Rows without a score or of
    another class are left out; a null stratum is one.
    """
    rows = df.select(score.cast("double").alias("s"), y.alias("y"), stratum.cast("string").alias("stratum")).where("s IS NOT NULL AND y IN (0, 1)")
    table = running(score_table(rows, F.col("s"), F.col("y")), [], "s", ["neg"])
    below = table.select(F.col("s").alias("__s"), (F.col("upto_neg") - F.col("neg") / 2).alias("won"), F.col("all_neg").alias("normals"))
    own = rows.where("y = 1").groupBy("stratum", "s").agg(F.count(F.lit(1)).alias("n"))  # by score: a stratum may be most rows
    own = own.join(below, own.s == below["__s"])
    missed, n = F.when(F.col("s") < threshold, F.col("n")).otherwise(0), F.sum("n")
    lesions = own.groupBy("stratum").agg(
        n.alias("total_samples"), F.sum(missed).alias("false_negatives"), F.lit(0).cast("long").alias("false_positives"),
        F.round(F.try_divide(F.sum(F.col("n") * F.col("won")), n * F.max("normals")), 9).alias("auc"),
        F.round(1 - F.sum(missed) / n, 9).alias("sensitivity"), F.lit(None).cast("double").alias("specificity"),
    )
    none, wrong = F.lit(None).cast("double"), F.count_if(F.col("s") >= threshold)
    normals = rows.where("y = 0").agg(
        F.lit(normal).alias("stratum"), F.count(F.lit(1)).alias("total_samples"), F.lit(0).cast("long").alias("false_negatives"), wrong.alias("false_positives"),
        none.alias("auc"), none.alias("sensitivity"), F.round(1 - F.try_divide(wrong, F.count(F.lit(1))), 9).alias("specificity"),
    )
    return lesions.unionByName(normals)
