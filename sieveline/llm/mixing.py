"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to).  A small flow network routes each pattern's token capacity to the quotas of
its sources; the second and third copy of a document cost more than the one
before.  A pattern's flow is then met by whole copies of all its documents and
one more copy of a seeded selection.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.shared import WORD, documents, or_empty, with_columns
from sieveline.operators.graph import components
from sieveline.sources.scratch import materialise, rekeyed


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight; none above ``most`` times its size, the
    excess being shared by weight among the others."""
    out: list[float | None] = [None] * len(sizes)
    left = float(total)
    while any(t is None for t in out):
        free = sum(w for w, t in zip(weights, out) if t is None)
        share = [left * w / free if t is None else t for w, t in zip(weights, out)]
        full = [k for k, t in enumerate(out) if t is None and share[k] > most * sizes[k]]
        if not full:
            return [float(s) for s in share]
        for k in full:
            out[k] = float(most * sizes[k])
        left = total - sum(t for t in out if t is not None)
    return [float(t) for t in out]


class Routing:
    """Flow of tokens from patterns to sources, by blocking flows.

    ``left[p]`` is what pattern p can still send, ``need[s]`` what source s still
    takes; member m carries ``flow[m]`` of at most ``room[m]`` from ``of[m]`` to
    ``to[m]``.  A round labels patterns and sources by their distance from what
    can still send, then sends along rising labels until nothing gets through;
    each member is looked at once a round, but for the steps of paths found.
    """

    def __init__(self, of: Sequence[int], to: Sequence[int], room: Sequence[int], patterns: int, need: Sequence[int]):
        self.of, self.to, self.room, self.need = list(of), list(to), list(room), list(need)
        self.flow = [0] * len(self.of)
        self.left = [0] * patterns
        self.out: list[list[int]] = [[] for _ in range(patterns)]
        self.back: list[list[int]] = [[] for _ in self.need]
        for m, (p, s) in enumerate(zip(self.of, self.to)):
            self.out[p].append(m)
            self.back[s].append(m)

    def label(self) -> bool:
        """Distances; whether a source that takes more is within reach."""
        self.near, self.far = [-1] * len(self.left), [-1] * len(self.need)  # of patterns, of sources
        here = [p for p, x in enumerate(self.left) if x > 0]
        for p in here:
            self.near[p] = 0
        step = 0
        while here:
            reached = []
            for p in here:
                for m in self.out[p]:
                    s = self.to[m]
                    if self.far[s] < 0 and self.flow[m] < self.room[m]:
                        self.far[s] = step + 1
                        reached.append(s)
            if any(self.need[s] > 0 for s in reached):
                return True
            here, step = [], step + 2
            for s in reached:
                for m in self.back[s]:
                    p = self.of[m]
                    if self.near[p] < 0 and self.flow[m] > 0:
                        self.near[p] = step
                        here.append(p)
        return False

    def block(self) -> None:
        """Send along rising labels until every path is blocked."""
        next_out, next_back = [0] * len(self.left), [0] * len(self.need)
        for start in [p for p, x in enumerate(self.left) if x > 0]:
            at, there, back = [start], [], []  # patterns of a path, members to sources and from them
            while self.left[start] > 0:
                p = at[-1]
                found = self._first(self.out[p], next_out, p, lambda m: self.flow[m] < self.room[m] and self.far[self.to[m]] == self.near[p] + 1)
                if found is None:  # a dead end: back to the source before, and on from there
                    if not there:
                        break
                    at.pop()
                    back.pop()
                    next_back[self.to[there.pop()]] += 1
                    continue
                s = self.to[found]
                if self.need[s] > 0:
                    there.append(found)
                    moved = min(self.left[start], self.need[s], *(self.room[m] - self.flow[m] for m in there), *(self.flow[m] for m in back))
                    for m in there:
                        self.flow[m] += moved
                    for m in back:
                        self.flow[m] -= moved
                    self.left[start] -= moved
                    self.need[s] -= moved
                    at, there, back = [start], [], []
                    continue
                returned = self._first(self.back[s], next_back, s, lambda m: self.flow[m] > 0 and self.near[self.of[m]] == self.far[s] + 1)
                if returned is None:
                    next_out[p] += 1
                    continue
                there.append(found)
                back.append(returned)
                at.append(self.of[returned])

    @staticmethod
    def _first(members: list[int], marks: list[int], node: int, passes: Callable[[int], bool]) -> int | None:
        """The first member from the node's mark on that passes; the mark moves on to it."""
        while marks[node] < len(members):
            if passes(members[marks[node]]):
                return members[marks[node]]
            marks[node] += 1
        return None

    def add(self, supply: Sequence[int]) -> None:
        """Send as much of what was left and of a new supply of each pattern as gets through."""
        self.left = [x + y for x, y in zip(self.left, supply)]
        while self.label():
            self.block()


def route(patterns: Sequence[tuple[Sequence[str | None], int]], quota: dict[str | None, float], *, most: int) -> list[int]:
    """Tokens that flow through each (sources, size) pattern at least cost; the
    c-th copy of a pattern costs (c - 1) squared a token.

    Costs stand on the patterns' supplies alone, so the cheapest greatest flow
    sends all first copies that get through, then the second ones, and so on: a
    later copy never takes back what a pattern has sent.
    """
    names = sorted(quota, key=lambda s: (s is None, (s or "").encode()))
    number = {s: k for k, s in enumerate(names)}
    members = [(p, number[s]) for p, (sources, _) in enumerate(patterns) for s in sorted(set(sources), key=number.__getitem__)]
    size = [n for _, n in patterns]
    net = Routing([p for p, _ in members], [s for _, s in members], [most * size[p] for p, _ in members], len(size), [round(quota[s]) for s in names])
    for _ in range(most):
        net.add(size)
    sent = [0] * len(size)
    for (p, _), x in zip(members, net.flow):
        sent[p] += x
    return sent


def source_targets(sizes: DataFrame, weights: Sequence[float], total: float, most: int) -> DataFrame:
    """(source, source_size, target) of (source, source_size): ``targets`` as a query.

    Sources are numbered in code point order, null last, by one sort: a row for
    each partition reaches the driver.  The common level of targets to weights
    rises until no further source is full; a round sums up two numbers.
    """
    spark = sizes.sparkSession
    ordered = sizes.orderBy(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id())
    ordered = materialise(ordered, "mix-sources").withColumn("part", F.shiftright("at", 33))
    parts = sorted(ordered.groupBy("part").count().collect())
    begin, rows = 0, []
    for part, n in parts:
        rows.append((part, begin))
        begin += n
    begins = materialise(spark.createDataFrame(rows, "p long, begin long"), "mix-begins")
    place = F.col("begin") + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int"))
    known = ordered.join(begins, F.col("part") == F.col("p")).select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).cast("double").alias("cap"))
    known = materialise(known, "mix-weights")
    level, before = 0.0, -1
    while True:
        full = F.col("cap") < F.col("w") * F.lit(level)
        n, filled, free = known.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        if n == before or not free:
            break
        level, before = (total - (filled or 0.0)) / free, n
    return known.select("source", "source_size", F.least("cap", F.col("w") * F.lit(level)).alias("target"))


def pattern_plans(rows: DataFrame, *, weights: Sequence[float], most: int, most_memberships: int) -> DataFrame:
    """What the mix takes of each pattern: ``copies`` of all its documents and
    ``more`` tokens of documents that get another one.

    Every pattern is routed by flow.  Patterns that share sources, directly or by
    way of others, are a group, and tasks route a group each; one whose pattern
    shares its source with no other is a group of its own.  A group of more than
    ``most_memberships`` (pattern, source) pairs raises an error.
    """
    patterns = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("docs"), F.sum("__size").alias("size"))
    patterns = materialise(patterns, "mix-patterns")
    members = patterns.select("__p", "size", F.explode(F.from_json("__p", "array<string>")).alias("source"))
    sizes = materialise(members.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("patterns")), "mix-sizes")
    total = float(patterns.agg(F.sum("size")).first()[0] or 0)
    goal = source_targets(sizes.select("source", "source_size"), weights, total, most)
    goal = goal.join(sizes.select(F.col("source").alias("s"), "patterns"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    told = members.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    told = materialise(told, "mix-members")
    per = told.groupBy("__p", "size").agg(F.sum("source_size").alias("ss"), F.sum("target").alias("target"), F.count(F.lit(1)).alias("sources"), F.max("patterns").alias("shared"))
    per = materialise(per, "mix-per-pattern")

    ends = told.select(F.xxhash64(F.lit(1), "__p").alias("a"), F.xxhash64(F.lit(2), "source").alias("b"), "__p", "source", "size", "target")
    joint = per.where("sources > 1 OR shared > 1").select(F.col("__p").alias("__j"))
    # The groups' names: only patterns that share sources have to be followed from one to the next.
    linked = ends.join(joint, F.col("__p") == F.col("__j"), "left_semi")
    names = ends.select("a", F.col("a").alias("root")).limit(0) if joint.isEmpty() else components(linked.select("a", "b")).select(F.col("node").alias("a"), "root")
    grouped = ends.join(names.withColumnRenamed("a", "__node"), F.col("a") == F.col("__node"), "left").select(F.coalesce("root", "a").alias("root"), "__p", "source", "size", "target")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > most_memberships:
            raise ValueError(f"{len(frame)} memberships of connected sources, more than most_memberships = {most_memberships}")
        name = lambda s: None if pd.isna(s) else s
        keys = sorted(frame["__p"].unique())
        size = dict(zip(frame["__p"], frame["size"]))
        quota = {name(s): t for s, t in zip(frame["source"], frame["target"])}
        found = route([(json.loads(k), int(size[k])) for k in keys], quota, most=most)
        return pd.DataFrame({"__p": keys, "flow": found})

    flows = grouped.groupBy("root").applyInPandas(run, "`__p` string, flow long")
    joined = patterns.join(flows.withColumnRenamed("__p", "__f"), F.col("__p") == F.col("__f")).join(per.select(F.col("__p").alias("__t"), "ss", "target"), F.col("__p") == F.col("__t"))
    some = F.col("size") > 0
    copies = F.when(some, F.expr("flow div size")).otherwise(0).cast("int")
    more = F.when(some, F.col("flow") % F.col("size")).otherwise(0)
    return materialise(joined.select(rekeyed(F.col("__p"), "string").alias("__q"), copies.alias("__copies"), more.alias("__more"), "docs", F.col("ss").alias("__ss"), F.col("target").alias("__target")), "mix-plan")


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (1, 2, 3),
    most: int = 3,
    seed: int = 20_240_607,
    bucket_docs: int = 1000,
    most_memberships: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """All rows of ``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``size`` counts words; ``copies`` is how often the mix takes the row, from 0
    to ``most``; ``taken`` is their product.  ``source_size`` and ``target`` are
    those of the row's source, or the sums over its sources where ``source_col``
    is an array.  Sources in code point order, null last, weigh ``weights``,
    repeating.

    The extra copy goes to documents in order of a seeded hash.  Whole hash
    buckets are taken while they fit; in the next bucket, of about
    ``bucket_docs`` documents, whatever still fits is taken in hash order, and
    one more document if that comes closer.  Reruns agree.

    A null text has size 0; a null source is a source; a null or empty array of
    sources is the null source.  Rows that repeat an id share its verdict, and
    so do rows with a null id.  An empty table gives an empty result; columns
    named like a result are replaced.
    """
    source, this = F.col(f"`{source_col}`"), F.col(f"`{id_col}`")
    null = F.array(F.lit(None).cast("string"))
    if isinstance(docs.schema[source_col].dataType, T.ArrayType):
        pattern = F.when(F.size(F.coalesce(source, F.array().cast("array<string>"))) > 0, F.array_sort(F.array_distinct(source))).otherwise(null)
    else:
        pattern = F.array(source.cast("string"))
    text = docs.withColumns(
        {
            "__size": F.regexp_count(or_empty(F.col(f"`{text_col}`")), F.lit(WORD)).cast("long"),
            "__p": F.to_json(pattern),
            "__h": F.xxhash64(F.lit(seed), this),
        }
    )
    rows = materialise(text.select(this.alias("__id"), "__h", "__size", "__p"), "mix-rows")

    table = pattern_plans(rows, weights=weights, most=most, most_memberships=most_memberships)
    table = table.withColumn("__buckets", F.greatest(F.lit(1), F.ceil(F.col("docs") / bucket_docs)).cast("int")).drop("docs")
    pattern_key = rekeyed(F.col("__p"), "string")

    # Which hash buckets are taken whole, and how much of the next one.
    bucket = F.pmod("__h", "__buckets").cast("int")
    units = rows.groupBy("__p", "__id", "__h").agg(F.sum("__size").alias("__size"))
    placed = units.join(table, pattern_key == F.col("__q")).where("__more > 0").withColumn("__bucket", bucket)
    sums = placed.groupBy("__p", "__more", "__bucket").agg(F.sum("__size").alias("size"))
    order = Window.partitionBy("__p").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("size").over(order)).where("upto > __more")
    cut = sums.groupBy(F.col("__p").alias("__cut")).agg(F.min_by(F.struct(F.col("__bucket").alias("__at"), (F.col("__more") - F.col("upto") + F.col("size")).alias("__rest")), "__bucket").alias("c"))
    cut = materialise(cut.select("__cut", "c.*"), "mix-cut")

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["__h", "__id"], kind="stable", na_position="last").reset_index(drop=True)
        left, taken = int(frame["__rest"].iloc[0]), []
        for size in frame["__size"]:
            taken.append(0 < size <= left)
            left -= int(size) * taken[-1]
        # One more if that is nearer than the gap.
        over = [(int(size), k) for k, (size, t) in enumerate(zip(frame["__size"], taken)) if not t and size > 0]
        if over and min(over)[0] - left < left:
            taken[min(over)[1]] = True
        return frame.loc[taken, ["__id", "__h"]].assign(__extra=1)

    edge = placed.join(cut, (pattern_key == rekeyed(F.col("__cut"), "string")) & (F.col("__bucket") == F.col("__at")))
    id_type = rows.schema["__id"].dataType.simpleString()
    picks = edge.select("__p", "__id", "__h", "__size", "__rest").groupBy("__p").applyInPandas(choose, f"__id {id_type}, __h long, __extra int")
    picks = materialise(picks, "mix-picks").withColumnsRenamed({"__id": "__pid", "__h": "__ph"})

    out = text.join(table, pattern_key == F.col("__q")).join(cut, pattern_key == rekeyed(F.col("__cut"), "string"), "left")
    out = out.join(picks, (F.col("__h") == F.col("__ph")) & this.eqNullSafe(F.col("__pid")), "left")
    # A pattern without a cut takes all its buckets, or none where nothing more is asked for.
    extra = F.when(F.col("__more") == 0, 0).when(F.col("__at").isNull() | (bucket < F.col("__at")), 1).otherwise(F.coalesce("__extra", F.lit(0)))
    copies = (F.col("__copies") + extra).cast("int")
    new = {"size": F.col("__size"), "source_size": F.col("__ss"), "target": F.col("__target"), "copies": copies, "taken": F.col("__size") * copies}
    out = with_columns(out, new)
    return out.select(*[f"`{c}`" for c in docs.columns if c not in new], *new)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
