"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

from .exact_dedup import OP6_SQL, op6_exact_dedup
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .jaccard_join import op3_jaccard_join
from .language_id import op1_language_id
from .lm_scoring import op5_lm_scoring
from .merkle import op11_merkle_manifest
from .mixing import OP8_SQL, op8_mix_sources
from .packing import op10_best_fit_packing
from .quality_rules import OP4_SQL, op4_quality_rules
from .substring_dedup import op7_substring_dedup
from .suffix_dedup import op9_suffix_dedup
from .token_files import op2_token_files
from .toxicity import op13_toxicity

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_files": op2_token_files,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_toxicity": op13_toxicity,
}
ORACLES = {
    "op4_quality_rules": OP4_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op8_mix_sources": OP8_SQL,
    "op12_hard_negatives": OP12_SQL,
}
