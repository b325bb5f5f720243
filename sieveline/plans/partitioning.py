"""Partitioning and leakage queries over ``embeddings`` and ``lineitem``."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.rng import hash_key
from sieveline.operators import metrics as M
from sieveline.operators import partition as P
from sieveline.operators import stats as S
from sieveline.plans.tables import SCORED, scored, table, values
from sieveline.sources.scratch import materialise

CLIENTS, CLASSES, SEED = 5, 10, 7
ALPHAS = (0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 10.0, float("inf"))
SWEEP_SEEDS = 20


@cache
def cuts(alpha: float, seed: int = 42) -> list[list[float]]:
    return P.cut_points(P.dirichlet_proportions(CLASSES, CLIENTS, alpha, seed))


def _split(spark, sf) -> DataFrame:
    """Train and test rows: of each class the first 30 per cent in seeded order are test."""
    ranked = P.rank_in(scored(spark, sf), ["label"], SEED, "vec_id")
    rows = ranked.withColumn("split", F.when(F.col("r") < F.floor(0.3 * F.col("n")), "test").otherwise("train")).drop("r", "n")
    return P.rank_in(materialise(rows, "split"), ["split", "label"], SEED, "vec_id")


def _assigned(spark, sf, alpha: float = 0.5) -> DataFrame:
    return materialise(P.assign_clients(_split(spark, sf), F.col("label"), cuts(alpha)).drop("r", "n"), "assigned")


def leak_scores(assigned: DataFrame, by: list[str]) -> DataFrame:
    """Test rows with their client's train rate (paired) and the train rate of all (pooled)."""
    train, test = assigned.where("split = 'train'"), assigned.where("split = 'test'")
    rates = train.groupBy(*by, "client").agg(F.round(F.avg("y"), 12).alias("paired"))
    whole = train.groupBy(*by).agg(F.round(F.avg("y"), 12).alias("pooled"))
    out = test.join(rates, [*by, "client"], "left")
    return out.join(whole, by) if by else out.crossJoin(F.broadcast(whole))


def leak_audit(spark, sf) -> DataFrame:
    """AUC of a predictor that only knows a client's label prior, under both protocols."""
    rows = materialise(leak_scores(_assigned(spark, sf), []), "leak-scores")
    paired = M.auc(rows, F.coalesce("paired", "pooled"), F.col("y")).withColumnRenamed("auc", "auc_paired")
    pooled = M.auc(rows, F.col("pooled"), F.col("y")).withColumnRenamed("auc", "auc_pooled")
    return paired.crossJoin(pooled)


def _grid() -> list[tuple]:
    return [(a, s, k, row) for a in ALPHAS for s in range(SWEEP_SEEDS) for k, row in enumerate(cuts(a, s))]


def _cells(spark, sf) -> DataFrame:
    """(alpha, seed, y, times, paired, pooled): test rows of every cell of the sweep by their clients, in one plan.

    A row's client depends on its place in its class alone, and the scores on
    the counts of each client: class sizes are all that is read of the rows.
    """
    grid = spark.createDataFrame(_grid(), "alpha double, seed int, k int, cuts array<double>")
    sizes = scored(spark, sf).groupBy("label", "y").agg(F.count(F.lit(1)).alias("n"))
    test = F.floor(0.3 * F.col("n"))
    sizes = sizes.select("label", "y", F.explode(F.array(F.struct(F.lit("test").alias("split"), test.alias("n")), F.struct(F.lit("train").alias("split"), (F.col("n") - test).alias("n")))).alias("part"))
    cells = grid.join(sizes.select("label", "y", "part.*"), F.col("label") == F.col("k"))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda c: F.floor(c * F.col("n"))), F.array(F.col("n")))
    cells = cells.withColumn("ends", ends).select("alpha", "seed", "split", "y", "ends", F.explode(F.sequence(F.lit(0), F.size("ends") - 2)).alias("client"))
    cells = cells.withColumn("times", F.get("ends", F.col("client") + 1) - F.get("ends", F.col("client"))).where("times > 0").drop("ends")
    train, rate = cells.where("split = 'train'"), F.round(F.sum(F.col("y") * F.col("times")) / F.sum("times"), 12)
    paired = train.groupBy("alpha", "seed", "client").agg(rate.alias("paired"))
    pooled = train.groupBy("alpha", "seed").agg(rate.alias("pooled"))
    rows = cells.where("split = 'test'").join(paired, ["alpha", "seed", "client"], "left").join(pooled, ["alpha", "seed"])
    return materialise(rows, "sweep")


def _sweep(spark, sf) -> DataFrame:
    """(alpha, seed, auc_paired, auc_pooled, leak) of every cell of the sweep."""
    rows = _cells(spark, sf)
    of = lambda score, name: M.auc(rows, score, F.col("y"), ["alpha", "seed"], F.col("times")).withColumnRenamed("auc", name)
    both = of(F.coalesce("paired", "pooled"), "auc_paired").join(of(F.col("pooled"), "auc_pooled"), ["alpha", "seed"])
    return both.withColumn("leak", F.round(F.col("auc_paired") - F.col("auc_pooled"), 9))


def stratified_split(spark, sf):
    return P.stratified_split(scored(spark, sf), "label", id_col="vec_id").select("vec_id", "split")


def dirichlet_assign(spark, sf):
    return P.assign_clients(P.rank_in(scored(spark, sf), ["label"], SEED, "vec_id"), F.col("label"), cuts(0.5)).select("vec_id", "client")


def paired_partition(spark, sf):
    return _assigned(spark, sf).select("vec_id", "split", "client")


def iid_even_split(spark, sf):
    return P.even_shards(scored(spark, sf), CLIENTS, id_col="vec_id", seed=SEED).groupBy("client").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("id_sum"))


def client_profile(spark, sf):
    return P.client_profile(_assigned(spark, sf).where("split = 'train'"), "label", range(CLASSES), F.col("y") == 1)


def shard_tiling_check(spark, sf):
    a = _assigned(spark, sf)
    return P.tiling_faults(a, scored(spark, sf), "vec_id")


def stratified_sample(spark, sf):
    return P.sample_per_group(scored(spark, sf), "label", 30, id_col="vec_id", seed=SEED).select("vec_id", "label")


def class_balanced_weights(spark, sf):
    return P.class_balanced_weights(scored(spark, sf), "label")


def client_repair(spark, sf):
    """Shards cut by a small alpha and repaired: size, classes and sum of ids of each client."""
    a = P.repair(P.rank_in(scored(spark, sf), ["label"], SEED, "vec_id"), "label", cuts(0.1), least=12)
    return a.groupBy("client").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("classes"), F.sum("vec_id").alias("id_sum"))


def prior_only_auc_paired(spark, sf):
    return leak_audit(spark, sf).select("auc_paired")


def prior_only_auc_pooled(spark, sf):
    return leak_audit(spark, sf).select("auc_pooled")


def alpha_sweep(spark, sf):
    return _sweep(spark, sf)


def leak_ttest(spark, sf):
    t = S.one_sample_t(_sweep(spark, sf), ["alpha"], "leak")
    return t.select("alpha", "n", *[F.round(c, 7).alias(c) for c in ("mean", "sd", "t")])


def leak_ttest_p(spark, sf):
    return S.with_t_p(S.one_sample_t(_sweep(spark, sf), ["alpha"], "leak"))


def leak_log_fit(spark, sf):
    f = S.linear_fit(_sweep(spark, sf), F.ln("alpha"), F.col("leak"))
    return f.select("n", *[F.round(c, 7).alias(c) for c in ("slope", "intercept", "r", "stderr")])


def _runs(spark, sf) -> DataFrame:
    """Run facts: method and seed from ``lineitem``, two metrics."""
    return table(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("method"), F.col("l_linenumber").alias("seed")).agg(F.avg("l_discount").alias("paired"), F.avg("l_tax").alias("pooled"))


def protocol_rank_shift(spark, sf):
    means = _runs(spark, sf).groupBy("method").agg(F.round(F.avg("paired"), 9).alias("paired"), F.round(F.avg("pooled"), 9).alias("pooled"))
    return S.rank_shift(means, "method", "paired", "pooled")


def spearman(spark, sf):
    return S.spearman(scored(spark, sf), F.col("s"), F.col("s2"))


SPLIT = f"""{SCORED},
r1 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || vec_id), vec_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM scored),
sp AS (SELECT vec_id, label, y, s, s2, CASE WHEN r < floor(0.3 * n) THEN 'test' ELSE 'train' END AS split FROM r1),
r2 AS (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY md5('{SEED}:' || vec_id), vec_id) - 1 AS r, count(*) OVER (PARTITION BY split, label) AS n FROM sp)"""


def _cut_values(alpha: float) -> str:
    return values([(k, row) for k, row in enumerate(cuts(alpha))], "k, cuts")


def assigned_sql(alpha: float = 0.5) -> str:
    return f"{SPLIT},\nasg AS (SELECT vec_id, label, y, split, len(list_filter(v.cuts, lambda c: floor(c * n) <= r))::INT AS client FROM r2 JOIN {_cut_values(alpha)} ON v.k = r2.label)"


def auc_sql(source: str, score: str, y: str, name: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""{name}_t AS (SELECT {keys}{score} AS sc, count(*) FILTER ({y} = 1) AS pos, count(*) FILTER ({y} = 0) AS neg FROM {source} GROUP BY {keys}{score}),
{name}_w AS (SELECT {keys}pos, neg, pos * (sum(neg) OVER ({part}ORDER BY sc) - neg + neg / 2) AS won FROM {name}_t),
{name} AS (SELECT {keys}round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(won) / (sum(pos) * sum(neg)) END, 9) AS auc FROM {name}_w{group})"""


def _leak_sql() -> str:
    return f"""{assigned_sql()},
rates AS (SELECT client, round(avg(y), 12) AS paired FROM asg WHERE split = 'train' GROUP BY client),
whole AS (SELECT round(avg(y), 12) AS pooled FROM asg WHERE split = 'train'),
test AS (SELECT a.y, coalesce(paired, pooled) AS paired, pooled FROM asg a LEFT JOIN rates USING (client), whole WHERE split = 'test'),
{auc_sql('test', 'paired', 'y', 'ap')},
{auc_sql('test', 'pooled', 'y', 'ao')}"""


SWEEP = f"""{SPLIT},
asg AS (SELECT v.alpha, v.seed, vec_id, y, split, len(list_filter(v.cuts, lambda c: floor(c * n) <= r))::INT AS client FROM r2 JOIN {values(_grid(), 'alpha, seed, k, cuts')} ON v.k = r2.label),
rates AS (SELECT alpha, seed, client, round(avg(y), 12) AS paired FROM asg WHERE split = 'train' GROUP BY ALL),
whole AS (SELECT alpha, seed, round(avg(y), 12) AS pooled FROM asg WHERE split = 'train' GROUP BY ALL),
test AS (SELECT a.alpha, a.seed, a.y, coalesce(paired, pooled) AS paired, pooled FROM asg a LEFT JOIN rates USING (alpha, seed, client) JOIN whole USING (alpha, seed) WHERE split = 'test'),
{auc_sql('test', 'paired', 'y', 'ap', 'alpha, seed')},
{auc_sql('test', 'pooled', 'y', 'ao', 'alpha, seed')},
sweep AS (SELECT alpha, seed, ap.auc AS auc_paired, ao.auc AS auc_pooled, round(ap.auc - ao.auc, 9) AS leak FROM ap JOIN ao USING (alpha, seed))"""
_RUNS = "runs AS (SELECT l_returnflag || l_linestatus AS method, l_linenumber AS seed, avg(l_discount) AS paired, avg(l_tax) AS pooled FROM lineitem GROUP BY ALL)"
_RANK = "rank() OVER (ORDER BY {c}{d}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"


def interleaved_shards(spark, sf) -> DataFrame:
    """Shards by draws that alternate with shuffles, of labels and evenly."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label")
    by_label = P.interleaved_partition(rows, "label", 5, 0.5, id_col="vec_id", seed=SEED)
    even = P.interleaved_partition(rows, "label", 5, float("inf"), id_col="vec_id", seed=SEED)
    return by_label.join(even.select("vec_id", F.col("client").alias("even_client")), "vec_id")


def interleaved_pairs(spark, sf) -> DataFrame:
    """Train and test shards by the same shares, drawn in one stream, with the share of each row's class and client."""
    rows = _split(spark, sf).select("vec_id", "label", "split")
    train, test = (rows.where(F.col("split") == s) for s in ("train", "test"))
    a, b, p = P.interleaved_pair(train, test, "label", 5, 0.5, id_col="vec_id", seed=SEED)
    shares = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in p])
    own = F.get(F.get(shares, F.when(F.col("label") >= 0, F.col("label").cast("int"))), F.col("client"))
    return a.unionByName(b).withColumn("share", F.round(own, 9))


def protocol_comparison(spark, sf) -> DataFrame:
    """AUC and sensitivity at 90 % specificity of each cell of the sweep under both protocols, and the inflation of the AUC."""
    keys = ["alpha", "seed"]
    rows = _cells(spark, sf)
    out = None
    for protocol in ("paired", "pooled"):
        score = F.coalesce(protocol, "pooled")
        one = M.auc(rows, score, F.col("y"), keys, F.col("times")).withColumnRenamed("auc", f"auc_{protocol}")
        sens = M.sensitivity_at(M.roc_points(rows, score, F.col("y"), keys, F.col("times")), 0.9, keys)
        one = one.join(sens.select(*keys, F.round("sensitivity", 9).alias(f"sens_{protocol}")), keys)
        out = one if out is None else out.join(one, keys)
    return out.withColumn("inflation", F.round(F.col("auc_paired") - F.col("auc_pooled"), 9))


def _sens_sql(score: str, name: str) -> str:
    k = "alpha, seed"
    return f"""{name}_t AS (SELECT {k}, {score} AS sc, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM test GROUP BY ALL),
{name}_r AS (SELECT {k}, sum(pos) OVER (PARTITION BY {k} ORDER BY sc DESC) AS tp, sum(neg) OVER (PARTITION BY {k} ORDER BY sc DESC) AS fp, sum(pos) OVER (PARTITION BY {k}) AS m, sum(neg) OVER (PARTITION BY {k}) AS n,
  pos, neg, lead(pos) OVER (PARTITION BY {k} ORDER BY sc DESC) AS pos1, lead(neg) OVER (PARTITION BY {k} ORDER BY sc DESC) AS neg1 FROM {name}_t),
{name} AS (SELECT {k}, round(coalesce(max(tp / m) FILTER (1 - fp / n >= 0.9 AND (pos1 IS NULL OR pos1 <> pos OR neg1 <> neg)), 0), 9) AS sens FROM {name}_r WHERE m > 0 AND n > 0 GROUP BY ALL)"""


QUERIES = {f.__name__: f for f in (leak_audit, stratified_split, dirichlet_assign, paired_partition, iid_even_split, client_profile, shard_tiling_check, stratified_sample, class_balanced_weights, client_repair, prior_only_auc_paired, prior_only_auc_pooled, alpha_sweep, leak_ttest, leak_ttest_p, leak_log_fit, protocol_rank_shift, spearman, interleaved_shards, interleaved_pairs, protocol_comparison)}
ORACLES = {
    "leak_audit": f"WITH {_leak_sql()} SELECT ap.auc AS auc_paired, ao.auc AS auc_pooled FROM ap, ao",
    "stratified_split": f"""WITH {SCORED}, r AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM scored),
t AS (SELECT *, round_even(n * 0.2, 0) AS nt, round_even(n * 0.1, 0) AS nv FROM r)
SELECT vec_id, CASE WHEN r < nt THEN 'test' WHEN r < nt + nv THEN 'val' ELSE 'train' END AS split FROM t""",
    "dirichlet_assign": f"WITH {SPLIT} SELECT vec_id, len(list_filter(v.cuts, lambda c: floor(c * n) <= r))::INT AS client FROM r1 JOIN {_cut_values(0.5)} ON v.k = r1.label",
    "paired_partition": f"WITH {assigned_sql()} SELECT vec_id, split, client FROM asg",
    "iid_even_split": f"""WITH o AS (SELECT vec_id, row_number() OVER (ORDER BY md5('{SEED}:' || vec_id), vec_id) - 1 AS r, count(*) OVER () AS n FROM embeddings),
q AS (SELECT vec_id, r, n // {CLIENTS} AS q, n % {CLIENTS} AS m FROM o)
SELECT (CASE WHEN r < m * (q + 1) THEN r // (q + 1) ELSE m + (r - m * (q + 1)) // greatest(q, 1) END)::INT AS client, count(*) AS n, sum(vec_id)::BIGINT AS id_sum FROM q GROUP BY 1""",
    "client_profile": f"WITH {assigned_sql()} SELECT client, count(*) AS n_train, round(100 * avg(y), 6) AS pct_abnormal, {', '.join(f'count(*) FILTER (label = {c}) AS n_{c}' for c in range(CLASSES))} FROM asg WHERE split = 'train' GROUP BY client",
    "shard_tiling_check": f"WITH {assigned_sql()} SELECT e.vec_id, count(a.vec_id) AS times FROM embeddings e LEFT JOIN asg a USING (vec_id) GROUP BY e.vec_id HAVING count(a.vec_id) <> 1",
    "stratified_sample": f"SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || vec_id), vec_id) AS r FROM embeddings) WHERE r <= 30",
    "class_balanced_weights": "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), w AS (SELECT label, n, (1 - 0.999::DOUBLE) / (1 - pow(0.999::DOUBLE, n)) AS raw FROM c) SELECT label, n, round(raw * count(*) OVER () / sum(raw) OVER (), 9) AS weight FROM w",
    "prior_only_auc_paired": f"WITH {_leak_sql()} SELECT ap.auc AS auc_paired FROM ap",
    "prior_only_auc_pooled": f"WITH {_leak_sql()} SELECT ao.auc AS auc_pooled FROM ao",
    "alpha_sweep": f"WITH {SWEEP} SELECT alpha, seed, auc_paired, auc_pooled, leak FROM sweep",
    "leak_ttest": f"WITH {SWEEP}, g AS (SELECT alpha, count(leak) AS n, avg(leak) AS mean, stddev_samp(leak) AS sd FROM sweep GROUP BY alpha) SELECT alpha, n, round(mean, 7) AS mean, round(sd, 7) AS sd, round(CASE WHEN n > 2 AND sd > 0 THEN mean / (sd / sqrt(n)) END, 7) AS t FROM g",
    "leak_log_fit": f"""WITH {SWEEP}, f AS (SELECT ln(alpha) AS x, leak AS y FROM sweep WHERE alpha < 'inf'::DOUBLE), g AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(y, x) AS r, count(*) AS n FROM f)
SELECT n, round(slope, 7) AS slope, round(intercept, 7) AS intercept, round(r, 7) AS r, round(abs(slope) * sqrt((1 / (r * r) - 1) / (n - 2)), 7) AS stderr FROM g""",
    "protocol_comparison": f"""WITH {SWEEP}, {_sens_sql('paired', 'at_paired')}, {_sens_sql('pooled', 'at_pooled')}
SELECT sweep.alpha, sweep.seed, auc_paired, auc_pooled, leak AS inflation, at_paired.sens AS sens_paired, at_pooled.sens AS sens_pooled FROM sweep JOIN at_paired USING (alpha, seed) JOIN at_pooled USING (alpha, seed)""",
    "protocol_rank_shift": f"""WITH {_RUNS}, m AS (SELECT method, round(avg(paired), 9) AS paired, round(avg(pooled), 9) AS pooled FROM runs GROUP BY method),
k AS (SELECT method, {_RANK.format(c='paired', d=' DESC')} AS rank_before, {_RANK.format(c='pooled', d=' DESC')} AS rank_after FROM m) SELECT *, rank_before - rank_after AS shift FROM k""",
    "spearman": f"WITH {SCORED}, k AS (SELECT {_RANK.format(c='s', d='')} AS a, {_RANK.format(c='s2', d='')} AS b FROM scored) SELECT round(corr(a, b), 9) AS rho, count(*) AS n FROM k",
}
