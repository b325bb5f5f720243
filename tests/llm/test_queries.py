"""Every query of the subpackage on a small folder: rows, columns and types; stages on odd tables."""

from __future__ import annotations

import random
import zlib

import pytest

import corpus_pipeline
from sieveline.llm import registry
from tests.llm.helpers import ODD, SCHEMA, prose, rows

#: The columns that each contract names, in order.
CONTRACT = {
    "op1_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op3_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op4_quality": "doc_id bigint, perplexity double, threshold double, trusted boolean, kept boolean",
    "op5_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op6_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op7_fingerprint": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op8_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op13_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
}
#: Those that don't return a row for each document.
OTHERS = {
    "op11_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op12_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(6)
    texts = [*ODD, *[prose(k, 40) for k in range(60)], prose(3, 40)]
    langs = [r.choice(["en", "de", None]) for _ in texts]
    spark.createDataFrame(rows(texts, langs), SCHEMA).write.parquet(f"{at}/documents.parquet")
    labels = [(k, k % 3 and 1, int(k % 4 == 1)) for k in range(len(texts)) if k % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    vectors = [(k, [r.gauss(0, 1) for _ in range(4)], k % 3) for k in range(150)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at, texts


@pytest.mark.parametrize("name", list(CONTRACT))
def test_query(spark, folder, name):
    at, texts = folder
    out = registry.queries()[name](spark, at)
    types = dict(out.dtypes)
    for column in CONTRACT[name].split(", "):
        c, kind = column.split()
        assert types[c] == kind
    found = out.collect()
    assert {x.doc_id for x in found} == set(range(len(texts)))
    if name != "op3_packing":
        assert len(found) == len(texts)
    if name in ("op1_language_id", "op8_toxicity"):
        n, k = (4, 2) if name == "op1_language_id" else (5, 0)
        assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % n == k) and 0 <= x.score <= 1 for x in found)


@pytest.mark.parametrize("name", list(OTHERS))
def test_other_query(spark, folder, name):
    out = registry.queries()[name](spark, folder[0])
    assert ", ".join(f"{c} {kind}" for c, kind in out.dtypes) == OTHERS[name]
    assert out.count() > 0


def test_queries_are_all_here():
    assert sorted(registry.queries()) == sorted([*CONTRACT, *OTHERS])


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_an_empty_table(spark, name, stage):
    out = stage(spark, spark.createDataFrame([], SCHEMA), "")
    assert out.count() == 0
    if name != "packing":
        assert out.columns == corpus_pipeline.COLUMNS


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[1:])
def test_stage_on_nulls_and_repeats(spark, name, stage):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "a b c", None, None, 5), (1, "a b c", None, None, 5), (2, "", "en", "s", 0)], SCHEMA)
    assert {x.doc_id for x in stage(spark, docs, "").collect()} <= {None, 1, 2}
