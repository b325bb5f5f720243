"""Curation queries over ``documents``: source is the class, a text's md5 the file hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import curate as C
from sieveline.plans.tables import table
from sieveline.sources.scratch import materialise



def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _codes(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(C.simhash(_docs(spark, sf), "doc_id", "text"), "codes")


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    exact = C.exact_links(_docs(spark, sf), "doc_id", F.md5(F.col("text").cast("binary")))
    near = C.near_pairs(_codes(spark, sf)).select("a", "b")
    return C.duplicate_groups(exact.union(near))


def _judged(spark: SparkSession, sf: str, label: str = "lang") -> DataFrame:
    """Documents with their verdict; ``whole`` tells whether a text, which stays behind, has the length it should."""
    docs = _docs(spark, sf).withColumn("whole", F.length("text") == F.col("n_chars")).drop("text")
    return C.verdicts(docs, _groups(spark, sf), id_col="doc_id", label_col=label, area=F.col("n_chars"), name=F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))


def exact_dup_groups(spark, sf):
    g = _docs(spark, sf).select(F.md5(F.col("text").cast("binary")).alias("md5"), "doc_id").groupBy("md5")
    return g.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def code64_bits(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", C.median_code(F.col("embedding")).alias("code"))


def lsh_band_pairs(spark, sf):
    return C.near_pairs(_codes(spark, sf))


def dup_components(spark, sf):
    return _groups(spark, sf).select("id", "root")


def dup_group_ids(spark, sf):
    g = _groups(spark, sf)
    docs = _docs(spark, sf).select("doc_id")
    return docs.join(g, docs.doc_id == g.id, "left").select("doc_id", F.coalesce("group_id", F.lit(-1).cast("long")).alias("dup_group"))


def label_conflict_verdict(spark, sf):
    return _judged(spark, sf, "source").select("doc_id", "dup_group", "dedup_verdict")


def survivor_pick(spark, sf):
    return _judged(spark, sf, "lang").select("doc_id", "dup_group", "dedup_verdict")


def dedup_report(spark, sf):
    return C.group_report(_judged(spark, sf, "lang"), id_col="doc_id", label_col="lang")


def curation_audit(spark, sf):
    return C.audit(_judged(spark, sf, "lang"), F.col("n_chars") >= 20, F.col("whole"))


def semi_anti_keys(spark, sf):
    """Documents whose (lang x size class) key is among the keys with 30 rows, and the others' count."""
    docs = _docs(spark, sf).withColumn("key", F.concat_ws("x", "lang", F.floor(F.col("n_chars") / 500).cast("string")))
    keys = docs.groupBy("key").count().where("count >= 30").select(F.col("key").alias("k"))
    inside = docs.join(keys, docs.key == keys.k, "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    outside = docs.join(keys, docs.key == keys.k, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return inside.union(outside.select(F.lit("(without)"), "n"))


def label_crosstab(spark, sf):
    return C.crosstab(_docs(spark, sf), "source", "lang", ["de", "en", "es", "fr"])


def resolution_counts(spark, sf):
    return C.counts_with_share(_docs(spark, sf), F.concat_ws("x", "lang", F.floor(F.col("n_chars") / 500).cast("string")), "resolution")


def imbalance_ratio(spark, sf):
    return C.imbalance(_docs(spark, sf), "lang")


_VOTES = ",\n".join(f"sum(({'lo' if i < 32 else 'hi'} >> {i % 32}) & 1) AS v{i}" for i in range(64))
_CODE = " + ".join(f"(CASE WHEN 2 * v{i} > n THEN {1 << i}::HUGEINT ELSE 0 END)" for i in range(64))
_SIGNED = "(CASE WHEN {v} >= 9223372036854775808::HUGEINT THEN {v} - 18446744073709551616::HUGEINT ELSE {v} END)::BIGINT"
SIM = f"""w AS (SELECT DISTINCT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')) AS w FROM documents),
h AS (SELECT id, ('0x' || substr(md5(w), 25, 8))::BIGINT AS lo, ('0x' || substr(md5(w), 17, 8))::BIGINT AS hi FROM w),
votes AS (SELECT id, count(*) AS n, {_VOTES} FROM h GROUP BY id),
big AS (SELECT id, {_CODE} AS v FROM votes),
codes AS (SELECT id, {_SIGNED.format(v='v')} AS code, v FROM big)"""
PAIRS = f"""{SIM},
banded AS (SELECT id, v, b.band, (v // pow(65536, b.band)::HUGEINT) % 65536 AS key FROM codes, (SELECT unnest([0, 1, 2, 3]) AS band) b),
sized AS (SELECT band, key FROM banded GROUP BY band, key HAVING count(*) BETWEEN 2 AND 400),
held AS (SELECT banded.* FROM banded JOIN sized USING (band, key)),
pairs AS (SELECT DISTINCT x.id AS a, y.id AS b, bit_count(xor(cx.code, cy.code))::INT AS d FROM held x JOIN held y ON x.band = y.band AND x.key = y.key AND x.id < y.id
          JOIN codes cx ON cx.id = x.id JOIN codes cy ON cy.id = y.id WHERE bit_count(xor(cx.code, cy.code)) <= 5)"""
GROUPS = f"""{PAIRS},
firsts AS (SELECT doc_id AS b, min(doc_id) OVER (PARTITION BY md5(text)) AS a FROM documents),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT a, b FROM firsts WHERE a <> b UNION SELECT b, a FROM firsts WHERE a <> b),
reach AS (SELECT a AS id, b AS other FROM edges UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other),
comp AS (SELECT id, least(id, min(other)) AS root FROM reach GROUP BY id),
gids AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS group_id FROM (SELECT DISTINCT root FROM comp)),
grouped AS (SELECT comp.id, comp.root, gids.group_id FROM comp JOIN gids USING (root))"""


def judged(label: str) -> str:
    return f"""{GROUPS},
facts AS (SELECT g.group_id, count(DISTINCT d.{label}) > 1 AS conflict, first(d.doc_id ORDER BY d.n_chars DESC, 'doc_' || d.doc_id) AS keep FROM grouped g JOIN documents d ON d.doc_id = g.id GROUP BY g.group_id),
judged AS (SELECT d.*, coalesce(g.group_id, -1) AS dup_group,
  CASE WHEN g.group_id IS NULL THEN 'kept' WHEN f.conflict THEN 'dropped_conflict' WHEN f.keep = d.doc_id THEN 'kept' ELSE 'dropped_duplicate' END AS dedup_verdict
  FROM documents d LEFT JOIN grouped g ON g.id = d.doc_id LEFT JOIN facts f ON f.group_id = g.group_id)"""


_KEY = "lang || 'x' || floor(n_chars / 500)::BIGINT"
QUERIES = {f.__name__: f for f in (exact_dup_groups, code64_bits, lsh_band_pairs, dup_components, dup_group_ids, label_conflict_verdict, survivor_pick, dedup_report, curation_audit, semi_anti_keys, label_crosstab, resolution_counts, imbalance_ratio)}
ORACLES = {
    "exact_dup_groups": "SELECT md5(text) AS md5, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "code64_bits": f"""WITH m AS (SELECT vec_id, embedding AS e, (list_sort(embedding)[32]::DOUBLE + list_sort(embedding)[33]::DOUBLE) / 2 AS med FROM embeddings),
b AS (SELECT vec_id, list_sum(list_transform(range(64), lambda i: CASE WHEN e[i + 1]::DOUBLE > med THEN pow(2::DOUBLE, i)::HUGEINT ELSE 0::HUGEINT END))::HUGEINT AS v FROM m)
SELECT vec_id, {_SIGNED.format(v='v')} AS code FROM b""",
    "lsh_band_pairs": f"WITH {PAIRS} SELECT a, b, d FROM pairs",
    "dup_components": f"WITH RECURSIVE {GROUPS} SELECT id, root FROM grouped",
    "dup_group_ids": f"WITH RECURSIVE {GROUPS} SELECT doc_id, coalesce(group_id, -1) AS dup_group FROM documents LEFT JOIN grouped ON id = doc_id",
    "label_conflict_verdict": f"WITH RECURSIVE {judged('source')} SELECT doc_id, dup_group, dedup_verdict FROM judged",
    "survivor_pick": f"WITH RECURSIVE {judged('lang')} SELECT doc_id, dup_group, dedup_verdict FROM judged",
    "dedup_report": f"""WITH RECURSIVE {judged('lang')} SELECT dup_group AS group_id, count(*) AS group_size, array_to_string(list_sort(list(DISTINCT lang)), ' | ') AS labels_in_group,
array_to_string(list_transform(list_sort(list(doc_id)), lambda x: x::VARCHAR), ' ; ') AS members, count(DISTINCT lang) > 1 AS cross_class_conflict,
CASE WHEN count(DISTINCT lang) > 1 THEN 'dropped_conflict' ELSE 'kept_one' END AS verdict FROM judged WHERE dup_group >= 0 GROUP BY dup_group""",
    "curation_audit": f"""WITH RECURSIVE {judged('lang')} SELECT count(*) AS n_raw, count(*) FILTER (NOT n_chars >= 20) AS corrupt_quarantined,
count(*) FILTER (n_chars >= 20 AND NOT length(text) = n_chars) AS undecodable,
count(*) FILTER (n_chars >= 20 AND length(text) = n_chars AND dedup_verdict = 'kept') AS kept,
count(*) FILTER (n_chars >= 20 AND length(text) = n_chars AND dedup_verdict = 'dropped_duplicate') AS dropped_duplicate,
count(*) FILTER (n_chars >= 20 AND length(text) = n_chars AND dedup_verdict = 'dropped_conflict') AS dropped_conflict,
count(DISTINCT CASE WHEN n_chars >= 20 AND length(text) = n_chars AND dup_group >= 0 THEN dup_group END) AS duplicate_groups FROM judged""",
    "semi_anti_keys": f"""WITH d AS (SELECT {_KEY} AS key FROM documents), k AS (SELECT key FROM d GROUP BY key HAVING count(*) >= 30)
SELECT key, count(*) AS n FROM d WHERE key IN (SELECT key FROM k) GROUP BY key UNION ALL SELECT '(without)', count(*) FROM d WHERE key NOT IN (SELECT key FROM k)""",
    "label_crosstab": "SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source",
    "resolution_counts": f"SELECT {_KEY} AS resolution, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM documents), 6) AS pct FROM documents GROUP BY 1",
    "imbalance_ratio": "SELECT round(max(c) / min(c), 3) AS imbalance_ratio, max(c) AS n_max, min(c) AS n_min FROM (SELECT count(*) AS c FROM documents GROUP BY lang)",
}
