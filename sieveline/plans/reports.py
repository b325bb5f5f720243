"""Report tables: names, look-ups, summaries in a fixed order, and checks of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.config import Curation
from sieveline.operators import attribution as X
from sieveline.operators import metrics as M
from sieveline.functions.arrays import doubles
from sieveline.plans.partitioning import auc_sql
from sieveline.plans.tables import POSTERIORS, posteriors, table, values

#: Methods in the order of a report, with a colour each.
ORDER = [("NO", "#1f77b4"), ("RF", "#d62728"), ("AF", "#2ca02c"), ("XX", "#7f7f7f")]
#: Client counts and the literal scores they are compared with.
LITERAL = [(1, 0.9416), (2, 0.8102), (3, 0.6954), (4, 0.4980)]


def _runs(spark, sf) -> DataFrame:
    """(method, round, auc, ece): facts of runs from ``lineitem``."""
    rows = table(spark, sf, "lineitem")
    return rows.select(F.concat("l_returnflag", "l_linestatus").alias("method"), F.col("l_linenumber").cast("int").alias("round"), F.col("l_discount").alias("auc"), F.col("l_tax").alias("ece"))


_RUNS = "runs AS (SELECT l_returnflag || l_linestatus AS method, l_linenumber::INT AS round, l_discount AS auc, l_tax AS ece FROM lineitem)"


def padded_names(spark, sf):
    """A name for each row: its class and its place in the class, zero-padded.

    Places come from counts of ranges of ids, so that no class is sorted in one task.
    """
    rows = table(spark, sf, "embeddings").select("vec_id", "label").withColumn("part", F.floor(F.col("vec_id") / 1024))
    sizes = rows.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))  # a row for each class and 1024 ids
    before = F.sum("n").over(Window.partitionBy("label").orderBy("part")) - F.col("n")
    sizes = sizes.select(F.col("label").alias("l"), F.col("part").alias("p"), before.alias("before"))
    own = F.row_number().over(Window.partitionBy("label", "part").orderBy("vec_id")) - 1
    named = rows.withColumn("own", own).join(sizes, (F.col("label") == F.col("l")) & (F.col("part") == F.col("p")))
    return named.select("vec_id", F.format_string("%d_%05d", "label", F.col("own") + F.col("before")).alias("name"))


def residual_count(spark, sf):
    """How many rows exceed the residual that is flagged."""
    residual = F.abs(F.get("embedding", F.lit(0)).cast("double"))
    return table(spark, sf, "embeddings").agg(F.count_if(residual > Curation().residual_flag).alias("flagged"), F.count(F.lit(1)).alias("n"))


def class_count(spark, sf):
    return table(spark, sf, "documents").agg(F.count_distinct("source").alias("classes"), F.count(F.lit(1)).alias("n"))


def method_colours(spark, sf):
    """Each method with its colour, the last one where none is given."""
    known = F.create_map(*[F.lit(x) for pair in ORDER for x in pair])
    return _runs(spark, sf).select("method").distinct().select("method", F.coalesce(known[F.col("method")], F.lit("#000000")).alias("colour"))


def method_summary(spark, sf):
    """Mean and deviation by method in the report's order; a method without runs keeps its row."""
    order = spark.createDataFrame([(k, m) for k, (m, _) in enumerate(ORDER)], "place int, method string")
    found = _runs(spark, sf).groupBy("method").agg(F.round(F.avg("auc"), 7).alias("mean"), F.round(F.stddev_samp("auc"), 7).alias("std"))
    return order.join(found, "method", "left")


def method_rounds(spark, sf):
    g = _runs(spark, sf).groupBy("method", "round")
    return g.agg(F.round(F.avg("auc"), 7).alias("mean"), F.round(F.stddev_samp("auc"), 7).alias("std"))


def coverage_by_system(spark, sf):
    g = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("system"), F.col("o_orderstatus").alias("coverage"))
    return g.agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_samp("o_totalprice"), 4).alias("std"), F.round(F.avg(F.col("o_custkey").cast("double")), 4).alias("other_mean"))


def leak_against_literal(spark, sf):
    """Prior-only scores by setting, beside the literal values of the replaced protocol."""
    literal = spark.createDataFrame(LITERAL, "setting int, literal double")
    g = _runs(spark, sf).groupBy(F.col("round").alias("setting")).agg(F.round(F.avg("auc"), 7).alias("mean"), F.round(F.stddev_samp("auc"), 7).alias("std"))
    return g.join(literal, "setting", "left").select("setting", "mean", "std", "literal", F.round(F.col("literal") - F.col("mean"), 7).alias("removed"))


def sweep_summary(spark, sf):
    """Means, deviations and counts by three keys; a null isn't counted."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", F.when(F.col("l_quantity") > 10, F.col("l_discount")).alias("leak"))
    g = rows.groupBy("l_returnflag", "l_linestatus", "l_linenumber")
    return g.agg(F.round(F.avg("leak"), 7).alias("leak_mean"), F.round(F.stddev_samp("leak"), 7).alias("leak_std"), F.count("leak").alias("n"))


def distinct_settings(spark, sf):
    """The settings of a run grid, each once with its place."""
    seen = _runs(spark, sf).select("round").distinct()
    return seen.select("round", F.row_number().over(Window.orderBy("round")).alias("place"))  # a row for each setting


def box_lookup(spark, sf):
    """Each row's crop box: that of its size, or else the picture without its border."""
    border = Curation().border
    boxes = spark.createDataFrame([(0, 2, 3, 200, 190), (1, 5, 5, 180, 170), (7, 0, 0, 64, 64)], "k int, bx int, by int, bw int, bh int")
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("int").alias("k"), (F.lit(100) + F.col("label") * 10).cast("int").alias("w"), (F.lit(90) + F.col("label") * 10).cast("int").alias("h"))
    joined = rows.join(boxes, "k", "left")
    edge = lambda side: F.col(side) - 2 * border
    return joined.select("vec_id", F.coalesce("bx", F.lit(border)).alias("x"), F.coalesce("by", F.lit(border)).alias("y"), F.coalesce("bw", edge("w")).alias("bw"), F.coalesce("bh", edge("h")).alias("bh"), F.col("bx").isNull().alias("fallback"))


def decodable_codes(spark, sf):
    """A code for each row: 0, and ``decodable`` false, where there is nothing to decode."""
    rows = table(spark, sf, "documents").select("doc_id", F.when(F.length("text") >= 8, F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 8), 16, 10).cast("long")).alias("c"))
    return rows.select("doc_id", F.coalesce("c", F.lit(0).cast("long")).alias("code"), F.col("c").isNotNull().alias("decodable"))


def _maps(spark, sf) -> DataFrame:
    cam = lambda k: X.min_max(doubles(F.slice("embedding", 1 + 32 * k, 32)))
    p = posteriors(spark, sf).select(F.col("vec_id").alias("id"), (F.col("pred") == F.col("y5")).alias("correct"))
    return table(spark, sf, "embeddings").select("vec_id", cam(0).alias("a"), cam(1).alias("b")).join(p, F.col("vec_id") == F.col("id"))


def descriptor_rows(spark, sf):
    """One row for each picture and model: the descriptors of its map and whether it was named rightly."""
    both = _maps(spark, sf).select("vec_id", "correct", F.explode(F.array(F.struct(F.lit("a").alias("model"), F.col("a").alias("map")), F.struct(F.lit("b").alias("model"), F.col("b").alias("map")))).alias("m"))
    both = both.select("vec_id", "correct", "m.*")
    return both.select("vec_id", "model", "correct", F.round(X.energy_top(F.col("map")), 7).alias("energy"), F.round(X.map_entropy(F.col("map")), 7).alias("entropy"), F.round(X.border_mass(F.col("map"), 4, 8), 7).alias("border"))


def descriptor_summary(spark, sf):
    """Means of the descriptors by model."""
    g = descriptor_rows(spark, sf).groupBy("model")
    return g.agg(*[F.round(F.avg(c), 5).alias(c) for c in ("energy", "entropy", "border")], F.round(F.avg(F.col("correct").cast("double")), 7).alias("accuracy"))


def shared_agreement(spark, sf):
    """Agreement of two models' maps over the pictures that both have."""
    rows = _maps(spark, sf)
    first = rows.where("vec_id % 3 <> 0").select("vec_id", "a")
    second = rows.where("vec_id % 2 = 0").select("vec_id", "b")
    return first.join(second, "vec_id").select("vec_id", F.round(X.agreement(F.col("a"), F.col("b")), 7).alias("agreement"))


def client_auc(spark, sf):
    """Score of the abnormal classes' chance, by client; null for a client of one class."""
    rows = posteriors(spark, sf).select((F.col("vec_id") % 7).alias("client"), (F.col("y5") <= 1).cast("int").alias("y"), F.round(F.get("p", F.lit(0)) + F.get("p", F.lit(1)), 7).alias("s"))
    return M.auc(rows, F.col("s"), F.col("y"), ["client"])


QUERIES = {
    f.__name__: f
    for f in (padded_names, residual_count, class_count, method_colours, method_summary, method_rounds, coverage_by_system, leak_against_literal, sweep_summary, distinct_settings, box_lookup, decodable_codes, descriptor_rows, descriptor_summary, shared_agreement, client_auc)
}
ORACLES = {
    "padded_names": "SELECT vec_id, printf('%d_%05d', label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) AS name FROM embeddings",
    "residual_count": f"SELECT count(*) FILTER (abs(embedding[1]::DOUBLE) > {Curation().residual_flag}) AS flagged, count(*) AS n FROM embeddings",
    "class_count": "SELECT count(DISTINCT source) AS classes, count(*) AS n FROM documents",
    "method_colours": f"WITH {_RUNS} SELECT method, coalesce(colour, '#000000') AS colour FROM (SELECT DISTINCT method FROM runs) LEFT JOIN {values(ORDER, 'method, colour')} USING (method)",
    "method_summary": f"WITH {_RUNS}, g AS (SELECT method, round(avg(auc), 7) AS mean, round(stddev_samp(auc), 7) AS std FROM runs GROUP BY method) SELECT place::INT AS place, method, mean, std FROM {values([(k, m) for k, (m, _) in enumerate(ORDER)], 'place, method')} LEFT JOIN g USING (method)",
    "method_rounds": f"WITH {_RUNS} SELECT method, round, round(avg(auc), 7) AS mean, round(stddev_samp(auc), 7) AS std FROM runs GROUP BY ALL",
    "coverage_by_system": "SELECT o_orderpriority AS system, o_orderstatus AS coverage, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, round(avg(o_custkey), 4) AS other_mean FROM orders GROUP BY ALL",
    "leak_against_literal": f"WITH {_RUNS}, g AS (SELECT round AS setting, round(avg(auc), 7) AS mean, round(stddev_samp(auc), 7) AS std FROM runs GROUP BY ALL) SELECT setting, mean, std, literal, round(literal - mean, 7) AS removed FROM g LEFT JOIN {values(LITERAL, 'setting, literal')} USING (setting)",
    "sweep_summary": "WITH r AS (SELECT l_returnflag, l_linestatus, l_linenumber, CASE WHEN l_quantity > 10 THEN l_discount END AS leak FROM lineitem) SELECT l_returnflag, l_linestatus, l_linenumber, round(avg(leak), 7) AS leak_mean, round(stddev_samp(leak), 7) AS leak_std, count(leak) AS n FROM r GROUP BY ALL",
    "distinct_settings": f"WITH {_RUNS} SELECT round, row_number() OVER (ORDER BY round)::INT AS place FROM (SELECT DISTINCT round FROM runs)",
    "box_lookup": f"""WITH e AS (SELECT vec_id, label, 100 + label * 10 AS w, 90 + label * 10 AS h FROM embeddings)
SELECT vec_id, coalesce(bx, {Curation().border})::INT AS x, coalesce(by_, {Curation().border})::INT AS y, coalesce(bw, w - {2 * Curation().border})::INT AS bw, coalesce(bh, h - {2 * Curation().border})::INT AS bh, bx IS NULL AS fallback
FROM e LEFT JOIN {values([(0, 2, 3, 200, 190), (1, 5, 5, 180, 170), (7, 0, 0, 64, 64)], 'k, bx, by_, bw, bh')} ON k = label""",
    "decodable_codes": "SELECT doc_id, CASE WHEN length(text) >= 8 THEN ('0x' || md5(text)[1:8])::BIGINT ELSE 0 END AS code, coalesce(length(text) >= 8, false) AS decodable FROM documents",
    "client_auc": f"WITH {POSTERIORS}, r AS (SELECT vec_id % 7 AS client, (y5 <= 1)::INT AS y, round(p[1] + p[2], 7) AS s FROM post), {auc_sql('r', 's', 'y', 'a', 'client')} SELECT client, auc FROM a",
}
