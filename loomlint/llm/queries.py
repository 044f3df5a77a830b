"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from .language_model import op4_lm_scores
from .mixing import op6_mixing
from .packing import op9_best_fit_packing
from .quality import op8_quality
from .sharding import op7_ring_shards
from .simhash import op10_simhash
from .substrings import op2_substring_dedup
from .token_counts import op3_token_counts
from .topk import OP5_SQL, op5_topk
from .vectors import OP1_SQL, op1_embedding_dedup

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_lm_scores": op4_lm_scores,
    "op5_topk": op5_topk,
    "op6_mixing": op6_mixing,
    "op7_ring_shards": op7_ring_shards,
    "op8_quality": op8_quality,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_simhash": op10_simhash,
}
ORACLES: dict[str, str] = {"op1_embedding_dedup": OP1_SQL, "op5_topk": OP5_SQL}
