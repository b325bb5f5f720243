"""A training-data pipeline over ``documents``: language ID, exact and near
deduplication, mixing, and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All stages but the last
return the columns of ``documents``; an empty table gives an empty result at
every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.exact_dedup import exact_dedup
from sieveline.llm.langid import UNKNOWN, fit_languages, identify
from sieveline.llm.minhash import near_duplicates
from sieveline.llm.mixing import mix_sources
from sieveline.llm.packing import pack_documents
from sieveline.sources.scratch import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language stay, those without a letter in their text go;
    where ``lang`` is null the language found is filled in.

    Null and empty texts go.  Rows that repeat are judged each.  Without any
    row of known language nothing can be told, and no document stays.
    """
    found = identify(docs.select(*COLUMNS), fit_languages(docs)).where(F.col("lang_pred") != UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays.

    Null texts equal empty ones; a row without an id stays only where its whole
    group has none; rows that repeat an id and a text stay together.
    """
    return exact_dedup(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the
    document with the smallest id stays.

    Texts without words and rows without an id resemble nothing and stay.
    """
    return near_duplicates(docs.select(*COLUMNS), words=5, percent=80).where("kept").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document that is taken twice is there twice, one that isn't taken goes.

    A null source is a source; texts without words go where their source is cut.
    """
    mixed = mix_sources(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is one piece, its end; a repeated row has pieces of its own.
    """
    return pack_documents(docs.select(*COLUMNS), tokenizer=TOKENIZER).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The language model, the seeded selection and the packing can't be told in SQL; tests compare the stages with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
