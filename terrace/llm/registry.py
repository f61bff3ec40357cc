"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_automaton import op6_bpe_automaton
from .hard_negatives import op12_hard_negatives
from .hilbert_ann import op4_hilbert_ann
from .language_id import op5_language_id
from .line_dedup import op8_line_dedup
from .packing import op9_harmonic_packing
from .passage_quality import op10_passage_quality
from .quality_rules import op7_quality_rules
from .simhash import op2_simhash_anchor
from .spelling import op13_spelling_variants
from .token_counts import op11_token_counts
from .token_store import op1_repair_tokens
from .toxicity import op3_toxicity

OPERATORS = (
    op1_repair_tokens,
    op2_simhash_anchor,
    op3_toxicity,
    op4_hilbert_ann,
    op5_language_id,
    op6_bpe_automaton,
    op7_quality_rules,
    op8_line_dedup,
    op9_harmonic_packing,
    op10_passage_quality,
    op11_token_counts,
    op12_hard_negatives,
    op13_spelling_variants,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {}
