"""Corpus curation: codes, near-duplicate bands, groups, verdicts, audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.arrays import doubles, median, pack_bits
from sieveline.operators.graph import components
from sieveline.sources.scratch import materialise, rekeyed


def valid_rows(df: DataFrame, valid: Column, order: str) -> DataFrame:
    """Rows that pass, with a dense zero-based ``row_id`` in ``order``.

    The numbering is a distributed count: rows are dealt by ranges of ``order``,
    numbered in their part, and shifted by the sizes of the parts before.
    """
    kept = df.where(valid).repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id())
    kept = materialise(kept, "valid")
    sizes = kept.groupBy("__part").count()  # a row for each part
    shift = sizes.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__shift"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return kept.withColumn("__own", own).join(F.broadcast(shift), "__part").withColumn("row_id", F.col("__own") + F.col("__shift")).drop("__part", "__own", "__shift")


def median_code(vector: Column) -> Column:
    """64-bit code of a 64-vector: bit i is set where component i is above the median (strictly)."""
    v = doubles(vector)
    return F.element_at(F.transform(F.array(median(v)), lambda m: pack_bits(F.transform(v, lambda x: x > m))), 1)


def simhash(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, code): majority vote of the 64 hash bits of a text's distinct lower-cased words.

    A text's words are summed in its own task, so that one row a text is
    exchanged.  Array functions in the row need no exchange but took four times
    as long (61 and 15 s at sf0.1), being interpreted.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"), lambda w: w != ""))
    rows = df.select(F.col(id_col).alias("id"), F.explode(words).alias("w")).select("id", F.md5(F.col("w").cast("binary")).alias("h"))
    lo, hi = F.conv(F.substring("h", 25, 8), 16, 10).cast("long"), F.conv(F.substring("h", 17, 8), 16, 10).cast("long")
    rows = rows.select("id", lo.alias("lo"), hi.alias("hi"))
    votes = [F.sum(F.shiftright(F.col("lo" if i < 32 else "hi"), i % 32).bitwiseAND(F.lit(1).cast("long"))).alias(f"v{i}") for i in range(64)]
    sums = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *votes)
    return sums.select("id", pack_bits(F.array(*[2 * F.col(f"v{i}") > F.col("n") for i in range(64)])).alias("code"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(codes: DataFrame, n_bands: int = 4) -> DataFrame:
    """(id, code, band, key): a row for each band of 64 / n_bands bits."""
    width = 64 // n_bands
    keyed = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda b: F.struct(b.alias("band"), F.call_function("shiftrightunsigned", F.col("code"), b * width).bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias("key")))
    return codes.select("id", "code", F.explode(keyed).alias("x")).select("id", "code", "x.band", "x.key")


def band_buckets(codes: DataFrame, n_bands: int = 4) -> DataFrame:
    """(band, key, size) of every bucket with at least two members."""
    return bands(codes, n_bands).groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")


def near_pairs(codes: DataFrame, *, distance: int = 5, n_bands: int = 4, cap: int = 400) -> DataFrame:
    """(a, b, d) with a < b: pairs that share a band and differ in at most ``distance`` bits.

    Buckets of more than ``cap`` members are passed over, as the definition
    says: ``skipped_buckets`` lists them.  Sizes are joined in, not windowed, so
    a hot bucket is dropped before any of its rows meet.
    """
    rows = bands(codes, n_bands)
    good = band_buckets(codes, n_bands).where(F.col("size") <= cap).select(F.col("band").alias("gb"), rekeyed(F.col("key")).alias("gk"))
    rows = rows.join(good, (F.col("band") == F.col("gb")) & (F.col("key") == F.col("gk")), "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")))
    d = hamming(F.col("a.code"), F.col("b.code"))
    return pairs.where(d <= distance).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), d.cast("int").alias("d")).distinct()


def skipped_buckets(codes: DataFrame, *, n_bands: int = 4, cap: int = 400) -> DataFrame:
    return band_buckets(codes, n_bands).where(F.col("size") > cap)


def exact_links(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """(a, b): each row to the first row with its key.  A star, never all pairs."""
    rows = df.select(F.col(id_col).alias("b"), key.alias("k"))
    first = rows.groupBy("k").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(F.concat("k", F.lit("")).alias("fk"), "a")
    return rows.join(first, rows.k == first.fk).where("a <> b").select("a", "b")


def duplicate_groups(edges: DataFrame) -> DataFrame:
    """(id, root, group_id, group_size): groups numbered from 0 by their smallest member."""
    comp = components(edges)
    sizes = comp.groupBy("root").agg(F.count(F.lit(1)).alias("group_size"))
    order = Window.orderBy("root")  # a row for each group
    numbered = sizes.withColumn("group_id", (F.row_number().over(order) - 1).cast("long"))
    return comp.join(numbered, "root").select(F.col("node").alias("id"), "root", "group_id", "group_size")


def verdicts(rows: DataFrame, groups: DataFrame, *, id_col: str, label_col: str, area: Column, name: Column) -> DataFrame:
    """All rows with ``dup_group`` (-1 alone) and ``dedup_verdict``.

    A group with two labels is dropped whole as a conflict; of another group the
    row with the largest area stays, the first by name if equal.  Rows meet by
    their id only; what a group decides is attached to its members' ids before.
    """
    g = groups.select(F.col("id").alias("__id"), "group_id")
    told = rows.select(F.col(id_col).alias("rid"), F.col(label_col).alias("label"), area.alias("area"), name.alias("name"))
    inside = told.join(g, F.col("rid") == F.col("__id")).select(F.col("group_id").alias("gid"), "rid", "label", "area", "name")
    facts = inside.groupBy("gid").agg(
        (F.min("label") != F.max("label")).alias("conflict"),
        F.min(F.struct((-F.col("area")).alias("area"), "name", "rid")).alias("first"),
    )
    decided = g.join(facts.select(rekeyed(F.col("gid")).alias("gid"), "conflict", F.col("first.rid").alias("keep")), F.col("group_id") == F.col("gid")).drop("gid")
    out = rows.join(decided, F.col(id_col) == F.col("__id"), "left").drop("__id")
    verdict = F.when(F.col("group_id").isNull(), "kept").when(F.col("conflict"), "dropped_conflict").when(F.col(id_col) == F.col("keep"), "kept").otherwise("dropped_duplicate")
    return out.withColumn("dedup_verdict", verdict).withColumn("dup_group", F.coalesce("group_id", F.lit(-1).cast("long"))).drop("group_id", "conflict", "keep")


def group_report(judged: DataFrame, *, id_col: str, label_col: str) -> DataFrame:
    """A row for each duplicate group: size, sorted labels, members in order, verdict."""
    rows = judged.where("dup_group >= 0").groupBy(F.col("dup_group").alias("group_id")).agg(
        F.count(F.lit(1)).alias("group_size"),
        F.array_join(F.sort_array(F.collect_set(label_col)), " | ").alias("labels_in_group"),
        F.array_join(F.transform(F.sort_array(F.collect_list(id_col)), lambda x: x.cast("string")), " ; ").alias("members"),
        (F.count_distinct(label_col) > 1).alias("cross_class_conflict"),
    )
    return rows.withColumn("verdict", F.when(F.col("cross_class_conflict"), "dropped_conflict").otherwise("kept_one"))


def audit(judged: DataFrame, valid: Column, decodable: Column) -> DataFrame:
    """One row of reconciled counters."""
    good = valid & decodable
    verdict = F.col("dedup_verdict")
    return judged.agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count_if(~valid).alias("corrupt_quarantined"),
        F.count_if(valid & ~decodable).alias("undecodable"),
        F.count_if(good & (verdict == "kept")).alias("kept"),
        F.count_if(good & (verdict == "dropped_duplicate")).alias("dropped_duplicate"),
        F.count_if(good & (verdict == "dropped_conflict")).alias("dropped_conflict"),
        F.count_distinct(F.when(good & (F.col("dup_group") >= 0), F.col("dup_group"))).alias("duplicate_groups"),
    )


def counts_with_share(df: DataFrame, key: Column, name: str) -> DataFrame:
    """(name, n, pct) in descending order of n."""
    counts = df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(name, "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("pct")).orderBy(F.desc("n"), name)


def imbalance(df: DataFrame, key: str) -> DataFrame:
    """Largest class count over the smallest, to 3 digits."""
    return df.groupBy(key).count().agg(F.round(F.max("count") / F.min("count"), 3).alias("imbalance_ratio"), F.max("count").alias("n_max"), F.min("count").alias("n_min"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of row by the given column values, zeros kept."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def required_first(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required columns in order, then the others."""
    return df.select(*required, *[c for c in df.columns if c not in required])
