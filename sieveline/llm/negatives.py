"""Hard negatives by norm-bucketed inner-product search.

Candidates are sorted by norm and packed into buckets; neighbouring buckets are
a run.  An inner product is at most the product of the norms, so a window of
scores needs only buckets whose greatest norm can still reach its lower limit
and the score of its running k-th find.  Blocks of anchors meet the runs that
they need in independent tasks: runs of the greatest norms first, then, with the
k-th scores found there, what is left of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.shared import small_batches
from sieveline.sources.scratch import materialise

LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Rows in a bucket, in a run, and anchors in a block; at most so many runs, whose norms the driver holds.
BUCKET, RUN, BLOCK, RUNS = 1024, 16_384, 256, 4096
#: Norms are rounded; a bound is widened by this share.
SLACK = 1 + 1e-9

BUCKETS = "run int, seq int, top double, row0 long, ids array<long>, labels array<string>, anchor array<boolean>, dim int, kind string, data binary"
ANCHORS = "row long, id long, label string, norm double, dim int, data binary"
FOUND = "row long, key long, score long, other long, other_row long"


def usable(vector: Column) -> Column:
    """No null vector, and no component that is null, infinite or no number."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, odd), F.lit(False))


def quantised(flat: np.ndarray, scale: float) -> np.ndarray:
    """Whole numbers as doubles; beyond what a double holds, the greatest double."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(flat.astype(float) * scale))


def packed(matrix: np.ndarray) -> tuple[str, bytes]:
    """The smallest type that holds the whole numbers."""
    most = np.abs(matrix).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind, matrix.astype(kind).tobytes()


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers as 64-bit integers; what lies beyond counts as the nearest of these."""
    d = min(a.shape[1], b.shape[1])  # missing components are zeros
    a, b = a[:, :d], b[:, :d]
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * d < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    out = np.zeros((len(a), len(b)), np.int64)
    right = whole(b)
    for k, row in enumerate(whole(a)):
        out[k] = [min(max(sum(x * y for x, y in zip(row, other)), LEAST), MOST) for other in right]
    return out


def norm_buckets(rows: DataFrame, scale: float) -> DataFrame:
    """The buckets of rows (id, label, vector, anchor), by falling norm: run, then seq."""
    small_batches(rows.sparkSession)
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = materialise(rows.withColumn("square", square), "vectors")
    runs = min(RUNS, max(1, -(-rows.count() // RUN)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def bucket(t: pa.Table) -> pa.RecordBatch:
            vectors = t["vector"].combine_chunks()
            size = np.diff(vectors.offsets.to_numpy())
            dim = int(size.max(initial=0))
            matrix = np.zeros((len(size), dim))
            matrix[np.arange(dim) < size[:, None]] = quantised(vectors.flatten().to_numpy(zero_copy_only=False), scale)
            kind, data = packed(matrix)
            with np.errstate(over="ignore"):
                top = float(np.sqrt((matrix * matrix).sum(1)).max())
            lists = [pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t[c].combine_chunks()) for c in ("id", "label", "anchor")]
            ones = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([top]), pa.array([(part << 40) + seq * BUCKET])]
            return pa.RecordBatch.from_arrays([*ones, *lists, pa.array([dim], pa.int32()), pa.array([kind]), pa.array([data], pa.binary())], names=[f.split()[0] for f in BUCKETS.split(", ")])

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            while len(table) >= BUCKET:
                yield bucket(table.slice(0, BUCKET))
                table, seq = table.slice(BUCKET), seq + 1
            held = table.to_batches()
        if held and len(table := pa.Table.from_batches(held)):
            yield bucket(table)

    ordered = rows.repartitionByRange(runs, F.desc("square"), "id", F.xxhash64("vector")).sortWithinPartitions(F.desc("square"))
    return materialise(ordered.select("id", "label", "vector", "anchor").mapInArrow(run, BUCKETS), "buckets")


def matrix_of(dim: int, kind: str, data: bytes) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, dim).astype(float) if dim else np.zeros((1, 0))


def anchors_of(buckets: DataFrame) -> DataFrame:
    """A row for each anchor, its vector as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                flags = [k for k, x in enumerate(b["anchor"]) if x]
                matrix = matrix_of(b["dim"], b["kind"], b["data"]) if b["dim"] else np.zeros((len(b["ids"]), 0))
                chosen = matrix[flags]
                with np.errstate(over="ignore"):
                    norm = np.sqrt((chosen * chosen).sum(1))
                columns = [[b["row0"] + k for k in flags], [b["ids"][k] for k in flags], [b["labels"][k] for k in flags], norm.tolist(), [b["dim"]] * len(flags), [r.tobytes() for r in chosen]]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in ANCHORS.split(", ")])

    return buckets.where(F.exists("anchor", lambda x: x)).mapInArrow(run, ANCHORS)


def best(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each window's finds: higher scores first, then smaller ids, null ids last."""
    first = Window.partitionBy("row", "key").orderBy(F.desc("score"), F.asc_nulls_last("other"), "other_row")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


class Finds:
    """The best ``k`` finds of each window of a block of anchors."""

    def __init__(self, first: dict, k: int, same: bool):
        self.k, self.same = k, same
        self.label = first["a_label"]
        self.a_row = np.array(first["a_row"], np.int64)
        norm = np.array(first["a_norm"])
        dims = first["a_dim"]
        self.matrix = np.zeros((len(dims), max(dims, default=0)))
        for n, (d, data) in enumerate(zip(dims, first["a_data"])):
            self.matrix[n, :d] = np.frombuffer(data, float)
        self.of, self.key, self.low, self.high, kth = (np.array(first[c], np.int64) for c in ("w_anchor", "w_key", "w_low", "w_high", "w_kth"))
        self.norm, self.kth = norm[self.of], np.maximum(kth, self.low)
        empty = np.empty(0, np.int64)
        self.window, self.score, self.id, self.row = empty, empty, empty, empty

    def visit(self, b: dict) -> None:
        """Work a bucket into the finds, unless its norms are too small for every window."""
        with np.errstate(over="ignore"):
            reach = self.norm * b["top"] * SLACK
        live = np.flatnonzero(reach >= self.kth.astype(float))
        if not len(live):
            return
        used, place = np.unique(self.of[live], return_inverse=True)
        matrix = matrix_of(b["dim"], b["kind"], b["data"]) if b["dim"] else np.zeros((len(b["ids"]), 0))
        score = products(self.matrix[used], matrix)
        rows = b["row0"] + np.arange(len(matrix))
        code: dict = {}
        labels = np.array([code.setdefault(x, len(code)) for x in b["labels"]])
        wanted = np.array([code.get(self.label[k], -1) for k in used])
        allowed = (labels == wanted[:, None]) if self.same else (labels != wanted[:, None])
        allowed &= rows != self.a_row[used][:, None]
        ids = np.array([MOST if x is None else x for x in b["ids"]], np.int64)
        for begin in range(0, len(live), 256):  # windows by windows: masks of at most 256 x BUCKET
            some, at = live[begin : begin + 256], place[begin : begin + 256]
            s = score[at]
            ok = allowed[at] & (s >= self.kth[some][:, None]) & (s <= self.high[some][:, None])
            w, c = np.nonzero(ok)
            self.add(some[w], s[w, c], ids[c], rows[c])

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(window):
            return
        window, score, ids, rows = (np.concatenate(x) for x in ((self.window, window), (self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((rows, ids, -score, window))
        window = window[order]
        rank = np.arange(len(window)) - np.searchsorted(window, window)
        order, window, rank = order[rank < self.k], window[rank < self.k], rank[rank < self.k]
        self.window, self.score, self.id, self.row = window, score[order], ids[order], rows[order]
        full = rank == self.k - 1
        self.kth[window[full]] = self.score[full]

    def result(self) -> pa.RecordBatch:
        columns = [self.a_row[self.of[self.window]], self.key[self.window], self.score, self.id, self.row]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in FOUND.split(", ")])


def anchor_blocks(windows: DataFrame, tops: list[float], first: int) -> DataFrame:
    """Blocks of anchors that need runs of much the same norm, a row for each run from ``first`` on that a block needs.

    ``windows``: the columns of an anchor and ``wins``, its windows (key, low, high, kth).
    """
    greatest = np.maximum.accumulate(np.array(tops)[::-1])[::-1]  # of this run and those behind it
    names = ["a_row", "a_label", "a_norm", "a_dim", "a_data", "w_anchor", "w_key", "w_low", "w_high", "w_kth"]
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.binary(), pa.int32(), *[pa.int64()] * 4]
    types = "a_row array<long>, a_label array<string>, a_norm array<double>, a_dim array<int>, a_data array<binary>, w_anchor array<int>, w_key array<long>, w_low array<long>, w_high array<long>, w_kth array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = 0, []

        def block() -> pa.RecordBatch:
            wins = [(n, w) for n, a in enumerate(held) for w in a["wins"]]
            columns = [[a[c] for a in held] for c in ("row", "label", "norm", "dim", "data")]
            columns += [[n for n, _ in wins], *([w[c] for _, w in wins] for c in ("key", "low", "high", "kth"))]
            need = min(a["need"] for a in held)
            lists = [pa.array([c], pa.list_(k)) for c, k in zip(columns, kinds)]
            last = int(np.count_nonzero(greatest * SLACK >= need))
            return pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + number]), pa.array([last], pa.int32()), *lists], names=["block", "last", *names])

        for batch in batches:
            for a in batch.to_pylist():
                held.append(a)
                if len(held) == BLOCK:
                    yield block()
                    number, held = number + 1, []
        if held:
            yield block()

    n = windows.count()
    limit = F.array_min(F.transform("wins", lambda w: F.greatest(w["low"], w["kth"])))
    need = F.when(limit <= 0, F.lit(0.0)).otherwise(F.when(F.col("norm") > 0, limit.cast("double") / F.col("norm")).otherwise(F.lit(float("inf"))))
    dealt = windows.withColumn("need", need).repartitionByRange(max(1, -(-n // (16 * BLOCK))), "need", "row").sortWithinPartitions("need", "row")
    made = dealt.mapInArrow(run, f"block long, last int, {types}").where(F.col("last") > first)
    return made.withColumn("run", F.explode(F.sequence(F.lit(first), F.col("last") - 1))).drop("last")


def search(windows: DataFrame, buckets: DataFrame, k: int, *, same: bool) -> DataFrame:
    """The first ``k`` finds of each window: (row, key, score, other, other_row, rank).

    ``windows``: the columns of an anchor and ``wins``, an array of (key, low,
    high).  ``same``: among rows of the anchor's label, else among the others.
    """
    tops = [r["top"] for r in buckets.groupBy("run").agg(F.max("top").alias("top")).orderBy("run").collect()]
    numbers = [r["run"] for r in buckets.select("run").distinct().orderBy("run").collect()]
    rank = F.array_position(F.array(*[F.lit(n) for n in numbers]), F.col("run")).cast("int") - 1
    payload = buckets.withColumn("b_run", rank).select("b_run", "seq", "top", "row0", "ids", "labels", "dim", "kind", "data")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, finds = None, None
        for batch in batches:
            of = batch.column("block").to_pylist()
            for n, number in enumerate(of):
                if number != block:
                    if finds:
                        yield finds.result()
                    block = number
                    finds = Finds({c: batch.column(c)[n].as_py() for c in batch.schema.names if c[:2] in ("a_", "w_")}, k, same)
                finds.visit({c: batch.column(c)[n].as_py() for c in ("top", "row0", "ids", "labels", "dim", "kind", "data")})
        if finds:
            yield finds.result()

    def step(ready: DataFrame, first: int, end: int) -> DataFrame:
        met = anchor_blocks(ready, tops[:end], first).join(payload, F.col("run") == F.col("b_run"))
        return materialise(best(met.drop("run", "b_run", "seq").mapInArrow(visit, FOUND), k), "finds")

    kth = lambda w, value: F.struct(w["key"].alias("key"), w["low"].alias("low"), w["high"].alias("high"), value.alias("kth"))
    none = F.lit(LEAST).cast("long")
    lead = max(1, len(tops) // 8)
    begun = windows.withColumn("wins", F.transform("wins", lambda w: kth(w, none)))
    found = step(begun, 0, lead)
    if lead == len(tops):
        return found
    full = found.where(F.col("rank") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("key", "score"))).alias("full"))
    full = full.withColumnRenamed("row", "full_row")  # as many entries as an anchor has windows
    known = windows.join(full, F.col("row") == F.col("full_row"), "left")
    known = known.withColumn("wins", F.transform("wins", lambda w: kth(w, F.coalesce(F.try_element_at("full", w["key"]), none))))
    later = step(known.drop("full", "full_row"), lead, len(tops))
    return materialise(best(found.drop("rank").unionByName(later.drop("rank")), k), "finds")


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    *,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    scale: float = 256.0,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component counts as floor(``scale`` * x); scores are exact inner products,
    higher ones first, ties by smaller id.  An anchor's positives are its first
    ``positives`` other rows of its label.  For each, the first ``negatives``
    rows of other labels with low_percent * positive <= 100 * negative <=
    high_percent * positive are returned.

    Rows with a null label, a null vector or a component that is null or not
    finite take no part.  Rows that repeat an id are rows of their own, and a
    row is never its own positive.  A null id is returned as null; in ties it
    counts as the greatest.  Vectors of different length are filled up with
    zeros.  Scores beyond 64 bits count as the nearest 64-bit integer.  Other
    columns are ignored; an empty table gives an empty result.
    """
    label, vector = F.col(f"`{label_col}`"), F.col(f"`{vector_col}`")
    taken = rows.where(label.isNotNull() & usable(vector)).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("string").alias("label"), vector.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")
    )
    buckets = norm_buckets(taken, scale)
    out = T.StructType.fromDDL("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if buckets.isEmpty():
        return rows.sparkSession.createDataFrame([], out)
    anchors = materialise(anchors_of(buckets), "anchors")
    long = lambda x: F.lit(x).cast("long")
    whole = F.array(F.struct(long(0).alias("key"), long(LEAST).alias("low"), long(MOST).alias("high")))
    near = search(anchors.withColumn("wins", whole), buckets, positives, same=True)
    near = near.select(F.col("row").alias("p_row"), F.col("other").alias("p_id"), F.col("other_row").alias("p_other"), F.col("score").alias("p_score"))

    wide = F.col("p_score").cast("decimal(20,0)")
    low, high = F.expr(f"({low_percent} * cast(p_score as decimal(20,0)) + 99) div 100"), F.expr(f"({high_percent} * cast(p_score as decimal(20,0))) div 100")
    # Below zero the two limits exclude each other.
    windows = near.where(wide >= 0).groupBy("p_row").agg(F.collect_list(F.struct(F.col("p_other").alias("key"), low.alias("low"), high.alias("high"))).alias("wins"))
    hard = search(anchors.join(windows, F.col("row") == F.col("p_row")).drop("p_row"), buckets, negatives, same=False)
    named = lambda c: F.when(F.col(c) != long(MOST), F.col(c))
    told = hard.join(near, (F.col("row") == F.col("p_row")) & (F.col("key") == F.col("p_other")))
    told = told.join(anchors.select(F.col("row").alias("a_row"), F.col("id").alias("anchor_id")), F.col("row") == F.col("a_row"))
    return told.select(
        "anchor_id", named("p_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), named("other").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    mixed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", "embedding", mixed.alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, c.r AS cr, c.vec_id AS id, a.label = c.label AS same,
    CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.r <> c.r),
p AS (
  SELECT ar, anchor_id, cr, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id, cr) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.ar, p.cr ORDER BY s.score DESC, s.id, s.cr)
QUALIFY row_number() OVER w <= 10
"""
