"""Splitting and non-IID partitioning."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions.rng import hash_key, uniform
from sieveline.operators.order import ranged
from sieveline.sources.scratch import materialise


def rank_in(df: DataFrame, by: Sequence[str], seed: int | str, id_col: str) -> DataFrame:
    """``r``, the zero-based place of a row in its class in seeded order, and the class size ``n``.

    The order is a hash, so a place is the number of rows of the class in the
    hash ranges before (at most 4096 counts a class) and the place in its range:
    no task orders a class.  A null class is a class.
    """
    rows = df.withColumn("__k", hash_key(seed, F.col(id_col))).withColumn("__b", F.substring("__k", 1, 3))
    sizes = rows.groupBy(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], F.col("__b").alias("__range")).agg(F.count(F.lit(1)).alias("__c"))
    own = [f"__by{k}" for k in range(len(by))]
    upto = F.sum("__c").over(Window.partitionBy(*own).orderBy("__range"))
    sizes = sizes.select(*own, "__range", (upto - F.col("__c")).alias("__before"), F.sum("__c").over(Window.partitionBy(*own)).alias("n"))
    same = F.col("__b").eqNullSafe(F.col("__range"))
    for mine, c in zip(own, by):
        same &= F.col(c).eqNullSafe(F.col(mine))
    within = Window.partitionBy(*by, "__b").orderBy("__k", id_col)
    placed = rows.join(sizes, same).withColumn("r", (F.row_number().over(within) - 1 + F.col("__before")).cast("long"))
    return placed.select(*df.columns, "r", "n")


def stratified_split(df: DataFrame, label: str, *, id_col: str, seed: int = 42, test: float = 0.2, val: float = 0.1) -> DataFrame:
    """``split``: per class the first round(test * n) rows in seeded order are test,
    the next round(val * n) val, the rest train.  Rounding is half-even."""
    ranked = rank_in(df, [label], seed, id_col)
    n_test, n_val = F.bround(F.col("n") * test), F.bround(F.col("n") * val)
    split = F.when(F.col("r") < n_test, "test").when(F.col("r") < n_test + n_val, "val").otherwise("train")
    return ranked.withColumn("split", split).drop("r", "n")


def split_groups(df: DataFrame, group: str, *, seed: int = 42, test: float = 0.2, val: float = 0.1) -> DataFrame:
    """``split`` by whole groups: a group's hash decides, so no group straddles."""
    u = uniform(seed, F.col(group))
    return df.withColumn("split", F.when(u < test, "test").when(u < test + val, "val").otherwise("train"))


def dirichlet_proportions(classes: int, clients: int, alpha: float, seed: int) -> np.ndarray:
    """Rows of client shares for each class: uniform for an infinite alpha, else
    Dirichlet draws of the frozen legacy generator, class by class."""
    if np.isinf(alpha):
        return np.full((classes, clients), 1 / clients)
    r = np.random.RandomState(seed)
    return np.stack([r.dirichlet([alpha] * clients) for _ in range(classes)])


def cut_points(p: np.ndarray) -> list[list[float]]:
    """Cumulated shares without the last one."""
    return [[float(x) for x in row[:-1]] for row in np.cumsum(p, axis=1)]


def assign_clients(ranked: DataFrame, label: Column, cuts: Sequence[Sequence[float]], name: str = "client") -> DataFrame:
    """A row goes to the client whose cuts floor(share * n) enclose its place in
    its class; ``label`` indexes ``cuts``."""
    own = F.get(F.array(*[F.array(*map(F.lit, row)) for row in cuts]), label)
    below = F.filter(own, lambda c: F.floor(c * F.col("n")) <= F.col("r"))
    return ranked.withColumn(name, F.size(below).cast("int"))


def even_shard(place: Column, n: Column, clients: int) -> Column:
    """The shard of a place from 0 among ``n``: near-equal sizes, the first n mod clients are one larger."""
    q, m = F.floor(n / clients), n % clients
    big = m * (q + 1)
    return F.when(place < big, F.floor(place / (q + 1))).otherwise(m + F.floor((place - big) / F.greatest(q, F.lit(1)))).cast("int")


def even_shards(df: DataFrame, clients: int, *, id_col: str, seed: int) -> DataFrame:
    """IID shards of near-equal size: the first n mod clients shards get one more row.

    The global order is a hash, so a row's shard only needs its place; places
    come from counts of hash prefixes, not from one sort.
    """
    key = hash_key(seed, F.col(id_col))
    rows = df.withColumn("__k", key).withColumn("__b", F.substring("__k", 1, 3))
    sizes = rows.groupBy("__b").count()  # 4096 at most
    before = sizes.select("__b", (F.sum("count").over(Window.orderBy("__b")) - F.col("count")).alias("__before"), F.sum("count").over(Window.partitionBy()).alias("__n"))
    placed = rows.join(F.broadcast(before), "__b").withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__k", id_col)) - 1 + F.col("__before"))
    return placed.withColumn("client", even_shard(F.col("__r"), F.col("__n"), clients)).drop("__k", "__b", "__before", "__n", "__r")


def client_profile(df: DataFrame, label: str, classes: Sequence[int], abnormal: Column) -> DataFrame:
    """Size, share of abnormal rows and count of each class for each client."""
    return df.groupBy("client").agg(
        F.count(F.lit(1)).alias("n_train"),
        F.round(100 * F.avg(abnormal.cast("double")), 6).alias("pct_abnormal"),
        *[F.count_if(F.col(label) == c).alias(f"n_{c}") for c in classes],
    )


def tiling_faults(assigned: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """Ids that an assignment lists not exactly once; empty if the shards tile."""
    seen = assigned.groupBy(id_col).agg(F.count(F.lit(1)).alias("times"))
    all_ids = rows.select(id_col).distinct()
    return all_ids.join(seen, id_col, "full").where(F.coalesce("times", F.lit(0)) != 1).select(id_col, F.coalesce("times", F.lit(0)).alias("times"))


def sample_per_group(df: DataFrame, group: str, most: int, *, id_col: str, seed: int) -> DataFrame:
    """At most ``most`` rows of each group, without replacement, in seeded order."""
    order = Window.partitionBy(group).orderBy(hash_key(seed, F.col(id_col)), id_col)  # tasks keep the first of a group before any exchange
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= most).drop("__r")


def class_balanced_weights(df: DataFrame, label: str, beta: float = 0.999) -> DataFrame:
    """Effective-number weights that sum to the number of classes."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    raw = counts.withColumn("raw", (1 - F.lit(beta)) / (1 - F.pow(F.lit(beta), F.greatest(F.col("n"), F.lit(1)))))
    every = Window.partitionBy()  # a row for each class
    return raw.select(label, "n", F.round(F.col("raw") * F.count(F.lit(1)).over(every) / F.sum("raw").over(every), 9).alias("weight"))


Interval = tuple[int, int, int]


def shard_intervals(sizes: Sequence[int], cuts: Sequence[Sequence[float]]) -> list[list[Interval]]:
    """Each client's rows as intervals (class, first place, end) of the classes'
    seeded orders, class by class; ``sizes`` and ``cuts`` go by class."""
    ends = [[0, *(int(np.floor(c * n)) for c in row), n] for n, row in zip(sizes, cuts)]
    return [[(k, row[c], row[c + 1]) for k, row in enumerate(ends) if row[c] < row[c + 1]] for c in range(len(ends[0]) - 1 if ends else 0)]


def _take(shard: list[Interval], rows: int, only: int | None = None) -> tuple[list[Interval], list[Interval]]:
    """The first ``rows`` rows of a shard, or of one class in it, and what stays, in order."""
    taken, left = [], []
    for k, a, b in shard:
        n = min(rows, b - a) if only in (None, k) else 0
        rows -= n
        if n:
            taken.append((k, a, a + n))
        if a + n < b:
            left.append((k, a + n, b))
    return taken, left


def repaired_intervals(shards: list[list[Interval]], classes: int, least: int) -> list[list[Interval]]:
    """Shards in which every client has ``least`` rows and two classes, where a donor can give them.

    Client by client, at most ``classes`` times: the largest shard gives, the
    first if equal, if it is another one and has twice ``least`` rows.  Rows of
    the first class that the receiver lacks go, or if it lacks none those of the
    class of the donor's first row: an eighth of the donor's rows of it, 4 at
    least, in the donor's order; its first ``least`` rows of any class if it has
    none.  Rows that arrive stand last in the receiver's order.
    """
    shards = [list(s) for s in shards]
    size = lambda s: sum(b - a for _, a, b in s)
    for client in range(len(shards)):
        for _ in range(classes):
            held = {k for k, _, _ in shards[client]}
            if size(shards[client]) >= least and len(held) >= 2:
                break
            donor = max(range(len(shards)), key=lambda c: (size(shards[c]), -c))
            if donor == client or size(shards[donor]) < 2 * least:
                break
            wanted = next((k for k in range(classes) if k not in held), shards[donor][0][0])
            pool = size([x for x in shards[donor] if x[0] == wanted])
            taken, left = _take(shards[donor], max(4, pool // 8), wanted) if pool else _take(shards[donor], least)
            shards[donor] = left
            shards[client] = shards[client] + taken
    return shards


def repair(ranked: DataFrame, label: str, cuts: Sequence[Sequence[float]], *, least: int) -> DataFrame:
    """``client`` of rows with places ``r`` in their classes (``rank_in``): cut by
    ``cuts`` and repaired.  The driver sees class sizes and intervals; rows are
    told by their place alone.  Labels number the classes; rows of other labels
    have no client."""
    counts = {r[0]: r[1] for r in ranked.where(F.col(label).between(0, len(cuts) - 1)).groupBy(label).count().collect()}
    classes = max(counts, default=-1) + 1
    shards = repaired_intervals(shard_intervals([counts.get(k, 0) for k in range(classes)], cuts[:classes]), classes, least)
    own: list[list[tuple[int, int]]] = [[] for _ in range(classes)]
    for client, shard in enumerate(shards):
        for k, _, end in shard:
            own[k].append((end, client))
    # An interval's end names it: a place belongs to the first end beyond it.
    ends = F.array(*[F.array(*[F.struct(F.lit(e).cast("long").alias("e"), F.lit(c).alias("c")) for e, c in sorted(x)]).cast("array<struct<e:bigint,c:int>>") for x in own]) if own else None
    if ends is None:
        return ranked.withColumn("client", F.lit(None).cast("int"))
    mine = F.get(ends, F.when(F.col(label) >= 0, F.col(label)))
    return ranked.withColumn("client", F.get(F.filter(mine, lambda x: x["e"] > F.col("r")), F.lit(0))["c"].cast("int"))


def place_in(df: DataFrame, by: Sequence[str], id_col: str) -> DataFrame:
    """``r``, the zero-based place of a row in its class in the order of ``id_col``, and the class size ``n``.

    As ``rank_in``, but by ranges of ids at approximate quantiles.  Rows of one id
    stand together, in any order; a null id comes first, a null class is a class.
    """
    rows = ranged(materialise(df, "placed"), id_col)
    own = [f"__by{k}" for k in range(len(by))]
    sizes = rows.groupBy(*[F.col(c).alias(o) for c, o in zip(by, own)], F.col("__range").alias("__part")).agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*own).orderBy("__part"))  # RANGES + 1 rows a class
    sizes = sizes.select(*own, "__part", (upto - F.col("__c")).alias("__before"), F.sum("__c").over(Window.partitionBy(*own)).alias("n"))
    same = F.col("__range").eqNullSafe(F.col("__part"))
    for mine, c in zip(own, by):
        same &= F.col(c).eqNullSafe(F.col(mine))
    within = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(F.asc_nulls_first(id_col))) - 1
    return rows.join(sizes, same).withColumn("r", (within + F.col("__before")).cast("long")).select(*df.columns, "r", "n")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd factors), element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shuffled_places(place: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Where the permutation of 0 to n - 1 that ``key`` names takes each place.

    A Feistel network permutes the least even number of bits that hold n places,
    and is applied again until the result is below n.
    """
    n, key = np.asarray(n, np.uint64), np.asarray(key, np.uint64)
    bits = np.ceil(np.log2(np.maximum(n, np.uint64(2)).astype(np.float64))).astype(np.uint64)
    bits += (np.uint64(1) << bits) < n  # where the logarithm of a large n was rounded down
    half = (bits + np.uint64(1)) // np.uint64(2)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, going = np.array(place, np.uint64), np.arange(len(n))
    while len(going):
        h, m, k, x = half[going], low[going], key[going], out[going]
        left, right = x >> h, x & m
        for r in range(1, rounds + 1):
            left, right = right, left ^ (_mixed(right + k + np.uint64(r * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & m)
        out[going] = (left << h) | right
        going = going[out[going] >= n[going]]
    return out.astype(np.int64)


@F.pandas_udf(T.LongType())
def _shuffled(place: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(shuffled_places(place.to_numpy(), n.to_numpy(), key.to_numpy()))


class Stream:
    """One seeded stream of draws.  A shuffle takes a key from it and moves it on by
    the number of rows, so later draws depend on the sizes of the classes before."""

    def __init__(self, seed: int) -> None:
        self.draws = np.random.Generator(np.random.Philox(seed))

    def shuffle(self, rows: int) -> int:
        key = int(self.draws.integers(1 << 63))
        self.draws.bit_generator.advance(rows)
        return key

    def shares(self, clients: int, alpha: float) -> np.ndarray:
        return np.full(clients, 1 / clients) if np.isinf(alpha) else self.draws.dirichlet([alpha] * clients)


def _class_sizes(placed: DataFrame, label: str) -> dict[int, int]:
    return {r[0]: r[1] for r in placed.where(F.col(label) >= 0).groupBy(label).count().collect()}  # a row for each class


def _dealt(placed: DataFrame, label: str, keys: Sequence[int], shares: Sequence[np.ndarray]) -> DataFrame:
    """``client`` of placed rows: shuffled by their class's key, cut by its shares."""
    if not keys:
        return placed.withColumn("client", F.lit(None).cast("int")).drop("r", "n")
    known = F.when(F.col(label).between(0, len(keys) - 1), F.col(label).cast("int"))
    key = F.coalesce(F.get(F.array(*map(F.lit, keys)), known), F.lit(0)).cast("long")
    moved = placed.withColumn("r", _shuffled("r", "n", key))
    out = assign_clients(moved, known, cut_points(np.stack(shares)))
    return out.withColumn("client", F.when(known.isNotNull(), F.col("client"))).drop("r", "n")


def interleaved_partition(df: DataFrame, label: str, clients: int, alpha: float, *, id_col: str, seed: int) -> DataFrame:
    """``client`` by draws that alternate: class by class a shuffle, then the class's shares.

    An infinite ``alpha`` shuffles all rows at once and cuts them evenly.  Nothing
    is repaired.  ``label`` numbers the classes from 0; other labels, null among
    them, have no client unless ``alpha`` is infinite.  The driver sees class
    sizes; a row works out its own place in the shuffle.
    """
    stream = Stream(seed)
    if np.isinf(alpha):
        placed = materialise(place_in(df, [], id_col), "placed")
        key = stream.shuffle(placed.count())
        place = _shuffled("r", "n", F.lit(key).cast("long"))
        return placed.withColumn("r", place).withColumn("client", even_shard(F.col("r"), F.col("n"), clients)).drop("r", "n")
    placed = materialise(place_in(df, [label], id_col), "placed")
    sizes = _class_sizes(placed, label)
    keys, shares = [], []
    for k in range(max(sizes, default=-1) + 1):
        keys.append(stream.shuffle(sizes.get(k, 0)))
        shares.append(stream.shares(clients, alpha))
    return _dealt(placed, label, keys, shares)


def interleaved_pair(train: DataFrame, test: DataFrame, label: str, clients: int, alpha: float, *, id_col: str, seed: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Both tables with ``client`` by the same shares, and the shares (classes x clients).

    Class by class: shares, a shuffle of the train rows, a shuffle of the test
    rows, from one stream.  Labels as in ``interleaved_partition``.
    """
    stream = Stream(seed)
    parts = [materialise(place_in(df, [label], id_col), "placed") for df in (train, test)]
    sizes = [_class_sizes(p, label) for p in parts]
    keys, shares = ([], []), []
    for k in range(max((c for s in sizes for c in s), default=-1) + 1):
        shares.append(stream.shares(clients, alpha))
        for own, size in zip(keys, sizes):
            own.append(stream.shuffle(size.get(k, 0)))
    a, b = (_dealt(p, label, own, shares) for p, own in zip(parts, keys))
    return a, b, np.array(shares).reshape(-1, clients)


def same_shards(a: DataFrame, b: DataFrame, columns: Sequence[str] = ("vec_id", "client")) -> DataFrame:
    """Rows in which two assignments differ; empty if they are equal."""
    x, y = a.select(*columns), b.select(*columns)
    return x.exceptAll(y).unionByName(y.exceptAll(x))
