"""The queries of this subpackage by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .ann import op9_learned_partitions
from .bpe import op5_byte_bpe
from .infill import OP13_SQL, op13_fill_in_middle
from .jaccard import OP2_SQL, op2_jaccard_prefix
from .jpeg import op3_baseline_jpeg
from .lines import OP7_SQL, op7_line_dedup
from .lm import op6_context_mixing
from .mixing import OP10_SQL, op10_weighted_fair_mix
from .sharding import op1_kd_shards
from .token_counts import op8_piece_counts
from .toxicity import op4_compression_toxicity
from .vector_codes import OP12_SQL, op12_segment_mean_codes
from .wrappers import op11_inferred_wrappers

QUERIES = {
    "op1_kd_shards": op1_kd_shards,
    "op2_jaccard_prefix": op2_jaccard_prefix,
    "op3_baseline_jpeg": op3_baseline_jpeg,
    "op4_compression_toxicity": op4_compression_toxicity,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_context_mixing": op6_context_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_piece_counts": op8_piece_counts,
    "op9_learned_partitions": op9_learned_partitions,
    "op10_weighted_fair_mix": op10_weighted_fair_mix,
    "op11_inferred_wrappers": op11_inferred_wrappers,
    "op12_segment_mean_codes": op12_segment_mean_codes,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_prefix": OP2_SQL,
    "op7_line_dedup": OP7_SQL,
    "op10_weighted_fair_mix": OP10_SQL,
    "op12_segment_mean_codes": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
