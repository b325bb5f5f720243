"""Exact deduplication by progressive refinement.

Documents are grouped by length, then by a hash of a short prefix, then by a
hash of the whole text.  The full hash is only computed for documents whose
(length, prefix) group has at least two members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.shared import MOST_BUCKETS, WHITE_SPACE, documents, materialise, or_empty, rekeyed, with_columns


def normalised(text: str | Column) -> Column:
    """Every run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(or_empty(text), WHITE_SPACE, " ")


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 256,
    most_buckets: int = MOST_BUCKETS,
) -> DataFrame:
    """All rows of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``full_hash``.

    * ``keep_id``: smallest id among rows whose normalised texts are equal;
    * ``group_size``: number of such rows; ``kept``: the row has that id;
    * ``full_hash``: SHA-256 of the normalised text, null where refinement
      ended before the text had to be read in full.

    Level 1 and 2 run on a scratch table of (length, prefix hash) counts.  What
    survives is handed to the second pass as hash buckets, eight for each
    surviving (length, prefix) group and ``most_buckets`` broadcast integers at
    most.  A bucket shared by chance only costs a needless full hash.  Where
    ``most_buckets`` wouldn't be enough, (length, prefix) of each row is joined
    with the groups instead, with an exchange of the rows.

    Null texts count as empty ones.  A null id is never the smallest unless all
    ids of the group are null.  Rows that repeat an id and its text are members
    like any other and share its verdict.  An empty table gives an empty
    result; columns named like a result are replaced.
    """
    text = docs.select(F.col(f"`{id_col}`").alias("__id"), normalised(F.col(f"`{text_col}`")).alias("__t"))
    levels = materialise(
        text.select(F.length("__t").alias("n"), F.xxhash64(F.substring("__t", 1, prefix_chars)).alias("p"))
        .groupBy("n", "p")
        .agg(F.count(F.lit(1)).alias("rows")),
        "exact-levels",
    )
    by_length = levels.groupBy("n").agg(F.sum("rows").alias("rows")).where("rows > 1")
    by_prefix = levels.where("rows > 1").join(by_length.select(F.col("n").alias("n1")), F.col("n") == F.col("n1"), "left_semi")
    by_prefix = materialise(by_prefix.select("n", "p"), "exact-groups")
    buckets = 1 << max(10, (8 * by_prefix.count()).bit_length())
    exact = buckets > most_buckets

    def place(n: Column, p: Column) -> Column:
        return F.xxhash64(n, p) if exact else F.pmod(F.xxhash64(n, p), F.lit(buckets)).cast("int")

    alive = materialise(by_prefix.select(place(F.col("n"), F.col("p")).alias("__bucket")).distinct(), "exact-alive")
    read = docs.withColumn("__t", normalised(F.col(f"`{text_col}`")))
    here = place(F.length("__t"), F.xxhash64(F.substring("__t", 1, prefix_chars)))
    flagged = read.withColumn("__b", here).join(alive if exact else F.broadcast(alive), F.col("__b") == F.col("__bucket"), "left")
    flagged = flagged.withColumn("__full", F.when(F.col("__bucket").isNotNull(), F.sha2(F.col("__t").cast("binary"), 256)))
    flagged = flagged.drop("__t", "__b", "__bucket")

    groups = (
        flagged.where(F.col("__full").isNotNull())
        .groupBy("__full")
        .agg(F.min(F.col(f"`{id_col}`")).alias("__keep"), F.count(F.lit(1)).alias("__size"))
        .where("__size > 1")
        .select(rekeyed(F.col("__full"), "string").alias("__group"), "__keep", "__size")
    )
    # A row that never was a candidate gets a key of its own, so that nulls don't meet in one task.
    own = F.coalesce(F.col("__full"), F.concat(F.lit("-"), F.col(f"`{id_col}`").cast("string")), F.lit("-"))
    joined = flagged.withColumn("__key", own).join(groups, F.col("__key") == F.col("__group"), "left")
    this = F.col(f"`{id_col}`")
    keep = F.when(F.col("__size").isNull(), this).otherwise(F.col("__keep"))
    out = with_columns(
        joined,
        {
            "keep_id": keep,
            "group_size": F.coalesce(F.col("__size"), F.lit(1).cast("long")),
            "kept": this.eqNullSafe(keep),
            "full_hash": F.col("__full"),
        },
    )
    return out.drop("__key", "__group", "__keep", "__size", "__full")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The digest every row must have is taken at the scan, so that no text is exchanged.
    digest = F.sha2(normalised("text").cast("binary"), 256)
    docs = documents(spark, sf_dir).select("doc_id", "text", digest.alias("text_sha256"))
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
