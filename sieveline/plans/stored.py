"""Queries of the stored forms: pictures written as files, vectors as arrays; codes without a cap."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions.batches import grouped, small_batches
from sieveline.operators import close, curate as C
from sieveline.operators.graph import components
from sieveline.plans.curation import GROUPS, _codes, _docs
from sieveline.plans.picturing import MARGIN, pictures
from sieveline.plans.tables import table
from sieveline.sources.arrays import read_rows, write_rows
from sieveline.sources.pictures import write_pictures
from sieveline.sources.readers import read_pictures
from sieveline.sources.scratch import materialise, scratch_path


def all_close_components(spark, sf):
    """Groups of equal texts and of close codes, buckets of any size included."""
    exact = C.exact_links(_docs(spark, sf), "doc_id", F.md5(F.col("text").cast("binary")))
    links = exact.union(close.close_links(_codes(spark, sf)))
    return components(links).select(F.col("node").alias("id"), "root")


def stored_pictures(spark, sf):
    """Each picture written as a file and read back: its size, and whether levels differ by less than 4 on average."""
    small_batches(spark)
    rows = materialise(pictures(spark, sf), "pictures")
    root = scratch_path(spark, "written")
    name = F.concat(F.col("vec_id").cast("string"), F.lit(".jpg"))
    told = write_pictures(rows, root, folder=F.lit("all"), name=name).select("name", "written")
    found = read_pictures(spark, root, ["all"]).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("width").alias("w"), F.col("height").alias("h"), F.col("data").alias("got"))
    rows = rows.select("vec_id", name.alias("name"), "data").join(told, "name").join(found, F.col("name") == F.col("file"), "left")

    names, kinds = ["vec_id", "written", "width", "height", "close"], ["long", "boolean", "int", "int", "boolean"]

    def compared(batches):
        import numpy as np

        def near(a, b):
            return a is not None and b is not None and len(a) == len(b) and bool(np.abs(np.frombuffer(a, np.uint8).astype(int) - np.frombuffer(b, np.uint8)).mean() < 4)

        told = ((*(x.as_py() for x in row), near(a.as_buffer(), b.as_buffer())) for batch in batches for *row, a, b in zip(*batch.columns))
        return grouped(told, names, kinds)

    return rows.select("vec_id", "written", "w", "h", "data", "got").mapInArrow(compared, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def stored_vectors(spark, sf):
    """Ids and vectors written as arrays and read back by ranges of rows."""
    rows = table(spark, sf, "embeddings").where("embedding IS NOT NULL")
    root = scratch_path(spark, "arrays")
    whole = F.concat(F.array(F.col("vec_id").cast("double")), F.col("embedding").cast("array<double>"))
    write_rows(rows.select(whole.alias("value")), root, "value")
    found = read_rows(spark, f"{root}/*.npy", task_bytes=1 << 20)
    v = F.col("value")
    return found.select(v[0].cast("long").alias("vec_id"), (F.size(v) - 1).alias("dims"), v[1].alias("first"), F.element_at(v, -1).alias("last"), F.array_max(F.slice(v, 2, 1 << 20)).alias("most"))


QUERIES = {f.__name__: f for f in (all_close_components, stored_pictures, stored_vectors)}
_SIDE = f"(8 * (6 + (label % 3)) + {2 * MARGIN})"
ORACLES = {
    "all_close_components": f"WITH RECURSIVE {GROUPS.replace('BETWEEN 2 AND 400', '>= 2')} SELECT id, root FROM grouped",
    "stored_pictures": f"""SELECT vec_id, vec_id % 50 <> 3 AS written, CASE WHEN vec_id % 50 <> 3 THEN {_SIDE}::INT END AS width,
CASE WHEN vec_id % 50 <> 3 THEN {_SIDE}::INT END AS height, vec_id % 50 <> 3 AS close FROM embeddings""",
    "stored_vectors": """SELECT vec_id, len(embedding)::INT AS dims, embedding[1]::DOUBLE AS first, embedding[len(embedding)]::DOUBLE AS last,
list_max(embedding)::DOUBLE AS most FROM embeddings WHERE embedding IS NOT NULL""",
}
