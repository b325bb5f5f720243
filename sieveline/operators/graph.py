"""Connected components of an undirected graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.sources.scratch import materialise, rekeyed


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end ``u`` has one edge and is no smaller end ``v``."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", *, most_rounds: int = 200) -> DataFrame:
    """(node, root) for every node of ``edges`` but isolated roots; root is the
    component's smallest node, and roots are listed with themselves.

    Large-star links every larger neighbour of a node to the node's smallest
    neighbour, small-star every smaller one and the node itself; together they
    end in a star around each smallest node after O(log^2 n) rounds.  A round
    is two aggregations and two joins that adaptive execution can split at a
    hub; its edges are written to a scratch table.  Rounds end when all edges
    form stars, which one aggregation tells.  Null ends are ignored.
    Labels are never returned unfinished: more than ``most_rounds`` rounds, far
    more than any graph needs, raise an error.
    """
    x, y = F.col(f"`{a}`").cast("long"), F.col(f"`{b}`").cast("long")
    now = edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct()
    now = materialise(now, "edges")
    for _ in range(most_rounds):
        if _stars(now):
            break
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(rekeyed(F.col("u")).alias("w"), F.least("m", "u").alias("m"))
        large = both.join(low, both.u == low.w).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        keyed = low.select(rekeyed(F.col("u")).alias("w"), "m")
        small = large.join(keyed, large.u == keyed.w).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components unfinished after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
