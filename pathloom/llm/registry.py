"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .codes import op13_vector_codes
from .hamming import op9_embedding_near_dedup
from .language import op6_language_id
from .mixing import op3_source_mixing
from .neardups import op5_minhash_near_dedup
from .neighbours import op1_nearest_neighbours
from .packing import op7_best_fit_packing
from .pseudonyms import op8_pii_pseudonyms
from .scoring import op4_lm_scoring
from .sessions import op11_gap_sessions
from .substrings import op2_substring_dedup
from .toxicity import op10_toxicity
from .warc import op12_warc_archives

_ALL = (
    op1_nearest_neighbours, op2_substring_dedup, op3_source_mixing, op4_lm_scoring, op5_minhash_near_dedup,
    op6_language_id, op7_best_fit_packing, op8_pii_pseudonyms, op9_embedding_near_dedup, op10_toxicity,
    op11_gap_sessions, op12_warc_archives, op13_vector_codes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    """The others hash, learn or iterate in ways that SQL can't express; see tests/llm."""
    return {
        "op2_substring_dedup": oracles.SUBSTRINGS, "op5_minhash_near_dedup": oracles.NEAR_DUPLICATES, "op9_embedding_near_dedup": oracles.NEAR_VECTORS,
        "op11_gap_sessions": oracles.SESSIONS, "op12_warc_archives": oracles.ARCHIVES, "op13_vector_codes": oracles.VECTOR_CODES,
    }
