"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches of ascending id.  The hashes of a batch's lines are
anti-joined with the runs written so far; the new ones become a sorted run of
level 0.  When a level holds ``fanout`` runs they are compacted into one sorted
run of the next level, so ``n`` batches leave about ``fanout * log(n)`` runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.shared import ascii_lower, documents, materialise, or_empty, rekeyed, with_columns
from sieveline.sources.scratch import bucketed_table, drop_table

#: The characters stripped at both ends of a line.
STRIPPED = " \t\n\x0b\x0c\r"


def line_keys(text: str | Column) -> Column:
    """The array of line keys of a text: A-Z lower-cased, white space stripped."""
    return F.transform(F.split(ascii_lower(or_empty(text)), "\n", -1), lambda x: F.btrim(x, F.lit(STRIPPED)))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row for each line with a long enough key: id, pos and a hash of 128 bits."""
    keys = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.posexplode(line_keys(F.col(f"`{text_col}`"))).alias("pos", "key"))
    return keys.where(F.length("key") >= min_chars).select("id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


@dataclass
class LineRuns:
    """The runs: which document was the first to hold a line.

    ``levels[k]`` lists the tables of the sorted runs of level ``k``.  A run has
    a row for each new hash with the smallest id of its batch that holds it.
    All runs lie in the same number of hash buckets, each bucket sorted, so that
    a batch is exchanged and sorted once and then merged with every run as it
    lies; no run is exchanged or sorted again.
    """

    spark: SparkSession
    fanout: int = 3
    buckets: int = 0
    levels: list[list[str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # Else Spark sorts a bucket again although its one file is sorted.
        self.spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def new_lines(self, lines: DataFrame) -> DataFrame:
        """(h1, h2, owner) of the hashes that no run holds."""
        own = lines.groupBy("h1", "h2").agg(F.min("id").alias("owner"))
        for run in self.tables():
            own = own.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        return own.select("h1", "h2", "owner")

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (id, h1, h2) whose ids are greater than all before."""
        self._write(self.new_lines(lines), 0)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self._compact(level)

    def _write(self, rows: DataFrame, level: int) -> None:
        table = bucketed_table(rows, f"line-run-{level}", ["h1", "h2"], self.buckets)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def _compact(self, level: int) -> None:
        old = self.levels[level]
        self.levels[level] = []
        # Runs share no hash, so that merging is putting their buckets together; one exchange makes a bucket one sorted file again.
        merged = reduce(DataFrame.union, [self.spark.table(name) for name in old])
        self._write(merged.repartition(self.buckets, "h1", "h2"), level + 1)
        for name in old:
            drop_table(self.spark, name)


def batch_bounds(docs: DataFrame, id_col: str, batches: int, ranges: int = 64) -> list:
    """The greatest ids of all but the last of ``batches`` consecutive batches of about as many rows."""
    ids = docs.select(F.col(f"`{id_col}`").alias("id")).where("id IS NOT NULL")
    parts = ids.repartitionByRange(ranges, "id").groupBy(F.spark_partition_id().alias("part")).agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    found = sorted(parts.collect(), key=lambda r: r["part"])  # a row for each range
    total, upto, bounds = sum(r["n"] for r in found), 0, []
    for r in found[:-1]:
        upto += r["n"]
        if upto * batches >= total * (len(bounds) + 1):
            bounds.append(r["last"])
    return bounds[: batches - 1]


def line_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    batches: int = 4,
    fanout: int = 3,
    runs: LineRuns | None = None,
) -> DataFrame:
    """All rows of ``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    A line whose key has ``min_chars`` code points or more and is found in two
    documents loses all its occurrences except those in the smallest id that
    holds it; the other lines stay, joined by line feeds.  Pass ``runs`` to go
    on from an index of earlier documents, whose ids must be smaller.  Ids may be
    of any type that is ordered.

    Only (id, position, hash) of lines is exchanged for the search; the texts
    are exchanged once, to meet the positions to drop.

    Null texts count as one empty line.  Rows with a null id lose no line.  Rows
    that repeat an id count as one document, each row losing the positions that
    were found for the id.  An empty table gives an empty result; columns named
    like a result are replaced.
    """
    spark = docs.sparkSession
    runs = runs or LineRuns(spark, fanout)
    bounds = batch_bounds(docs, id_col, batches)
    batch: Column = F.lit(0)
    for k, last in enumerate(bounds, 1):
        batch = F.when(F.col("id") > F.lit(last), k).otherwise(batch)
    lines = line_hashes(docs, id_col, text_col, min_chars).withColumn("batch", batch)
    lines = materialise(lines, "lines", partition_by="batch")
    for k in range(len(bounds) + 1):
        runs.add(lines.where(F.col("batch") == k))

    # The key of a run is handed over, so that both sides are exchanged and a line that is everywhere can be split.
    owners = reduce(DataFrame.union, runs.tables()).select(rekeyed(F.col("h1")).alias("o1"), rekeyed(F.col("h2")).alias("o2"), "owner")
    later = lines.join(owners, (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")) & (F.col("id") > F.col("owner")))
    drops = later.groupBy(F.col("id").alias("__id")).agg(F.collect_set("pos").alias("__drop"))
    joined = docs.join(drops, F.col(f"`{id_col}`") == F.col("__id"), "left")
    parts = joined.withColumn("__lines", F.split(or_empty(F.col(f"`{text_col}`")), "\n", -1))
    count = F.size("__lines")
    stay = F.array_except(F.sequence(F.lit(0), count - 1), F.coalesce("__drop", F.array().cast("array<int>")))
    kept = F.when(F.col("__drop").isNull(), or_empty(F.col(f"`{text_col}`"))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n")
    )
    dropped = F.coalesce(F.size(F.filter("__drop", lambda i: i < count)), F.lit(0)).cast("long")
    out = with_columns(parts, {"n_lines": count.cast("long"), "n_dropped": F.when(F.col("__drop").isNull(), F.lit(0).cast("long")).otherwise(dropped), "kept_text": kept})
    return out.drop("__id", "__drop", "__lines")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), owners AS (
  SELECT k, min(doc_id) AS owner, count(DISTINCT doc_id) AS docs FROM keyed WHERE length(k) >= 10 GROUP BY k
), marked AS (
  SELECT y.doc_id, y.pos, y.line, coalesce(o.docs > 1 AND y.doc_id <> o.owner, false) AS gone
  FROM keyed y LEFT JOIN owners o ON y.k = o.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
