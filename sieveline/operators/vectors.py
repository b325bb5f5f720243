"""Centroids, routing, ensembles and weighted state averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.arrays import dot, doubles, softmax, unit, vector_mean


def centroids(df: DataFrame, by: str, vector: str, size: int) -> DataFrame:
    """(by, centroid): the mean vector of each group, divided by its norm."""
    means = df.groupBy(by).agg(vector_mean(F.col(vector), size).alias("m"))
    return means.select(by, unit(F.col("m")).alias("centroid"))


def nearest(df: DataFrame, cents: DataFrame, by: str, vector: str) -> DataFrame:
    """All rows with ``assigned``: the group with the greatest dot product, the
    smallest if equal.  There are as many centroids as clients; they ride along
    as one array, so no rows are multiplied."""
    table = cents.agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), "centroid"))).alias("__c"))
    sims = F.transform("__c", lambda c: F.struct(F.round(dot(doubles(F.col(vector)), c["centroid"]), 12).alias("sim"), (-c["k"]).alias("k")))
    return df.crossJoin(F.broadcast(table)).withColumn("assigned", (-F.array_max(sims)["k"]).cast("int")).drop("__c")


def ensemble(p_by_model: DataFrame, row: str, p: str, classes: int) -> DataFrame:
    """(row, logp): the log of the mean posterior over models, clipped at 1e-12."""
    means = p_by_model.groupBy(row).agg(vector_mean(F.col(p), classes).alias("m"))
    return means.select(row, F.transform("m", lambda x: F.ln(F.greatest(x, F.lit(1e-12)))).alias("logp"))


def routed(p_by_model: DataFrame, assigned: DataFrame, row: str, client: str, p: str) -> DataFrame:
    """Each row's posterior from the model it is assigned to."""
    a = assigned.select(F.col(row).alias("__r"), F.col("assigned").alias("__a"))
    return p_by_model.join(a, (F.col(row) == F.col("__r")) & (F.col(client) == F.col("__a"))).select(row, client, p)


def linear_posteriors(df: DataFrame, weights: DataFrame, row: str, vector: str) -> DataFrame:
    """(row, client, p): softmax of each client's linear head; ``weights`` is a
    small table (client, w array<array<double>>)."""
    rows = df.select(row, doubles(F.col(vector)).alias("v")).crossJoin(F.broadcast(weights))
    return rows.select(row, "client", softmax(F.transform("w", lambda w: dot(F.col("v"), w))).alias("p"))


def is_private(key: Column, suffixes: list[str]) -> Column:
    """A parameter is private if its name is, or starts with, a private part."""
    out = F.lit(False)
    for s in suffixes:
        out = out | (key == s) | key.startswith(f"{s}.")
    return out


def weighted_average(states: DataFrame, sizes: DataFrame, private: list[str] | None = None) -> DataFrame:
    """(key, idx, value): mean over clients weighted by rows; private keys stay
    out; keys that aren't floats come from the first client.

    ``states`` is (client, key, idx, value, is_float), ``sizes`` (client, n).
    """
    rows = states.where(~is_private(F.col("key"), private or [])).join(F.broadcast(sizes), "client")  # a row for each client
    g = rows.groupBy("key", "idx").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.min_by("value", "client").alias("first"), F.min("is_float").alias("is_float"))
    return g.select("key", "idx", F.when(F.col("is_float"), F.col("mean")).otherwise(F.col("first")).alias("value"))


def payload(states: DataFrame, private: list[str] | None = None) -> DataFrame:
    """(client, bytes): four bytes for each shared float."""
    shared = F.col("is_float") & ~is_private(F.col("key"), private or [])
    return states.groupBy("client").agg(F.sum(F.when(shared, 4).otherwise(0)).alias("bytes"))


def traffic(rounds: DataFrame, bytes_up: int, clients: int) -> DataFrame:
    """Megabytes of each round, both ways, and their running sum."""
    mb = F.lit(bytes_up * clients * 2 / 2**20)
    run = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rounds.select("round", F.round(mb, 9).alias("comm_mb_round"), F.round(F.count(F.lit(1)).over(run) * mb, 9).alias("comm_mb_cum"))


def overlay(shared: DataFrame, own: DataFrame, private: list[str], whole: bool = False) -> DataFrame:
    """(client, key, idx, value): the shared state with a client's private keys,
    or, with ``whole``, all its own keys, laid over it."""
    clients = own.select("client").distinct()
    base = shared.select("key", "idx", F.col("value").alias("shared")).crossJoin(F.broadcast(clients))  # a row for each client
    mine = own.where(F.lit(True) if whole else is_private(F.col("key"), private)).select("client", "key", "idx", F.col("value").alias("mine"))
    return base.join(mine, ["client", "key", "idx"], "full").select("client", "key", "idx", F.coalesce("mine", "shared").alias("value"))
