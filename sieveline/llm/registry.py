"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm.collocations import OP12_SQL, op12_collocations
from sieveline.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from sieveline.llm.fingerprint import op7_fingerprint
from sieveline.llm.langid import op1_language_id
from sieveline.llm.line_dedup import OP2_SQL, op2_line_dedup
from sieveline.llm.lm_scoring import op13_lm_scoring
from sieveline.llm.minhash import OP6_SQL, op6_minhash_near_dedup
from sieveline.llm.mixing import op9_mixing
from sieveline.llm.negatives import OP11_SQL, op11_hard_negatives
from sieveline.llm.packing import op3_packing
from sieveline.llm.quality import op4_quality
from sieveline.llm.secrets import op10_secrets
from sieveline.llm.toxicity import op8_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_line_dedup": op2_line_dedup,
        "op3_packing": op3_packing,
        "op4_quality": op4_quality,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_minhash_near_dedup": op6_minhash_near_dedup,
        "op7_fingerprint": op7_fingerprint,
        "op8_toxicity": op8_toxicity,
        "op9_mixing": op9_mixing,
        "op10_secrets": op10_secrets,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_collocations": op12_collocations,
        "op13_lm_scoring": op13_lm_scoring,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op6_minhash_near_dedup": OP6_SQL, "op11_hard_negatives": OP11_SQL, "op12_collocations": OP12_SQL}
