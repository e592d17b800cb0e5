"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import secrets
from .ann import op1_collision_ann
from .bpe import op6_bpe_chunks
from .fingerprint import op3_cdc_fingerprints
from .html_extract import op4_crf_extract
from .ngram_join import op5_grouped_prefix_join
from .packing import op9_best_fit_packing
from .quality import op10_ordinal_quality
from .secrets import op2_secret_ownership
from .substring_dedup import op7_parse_dedup
from .token_counts import op8_delta_rollups

QUERIES = {
    f.__name__: f
    for f in (op1_collision_ann, op2_secret_ownership, op3_cdc_fingerprints, op4_crf_extract, op5_grouped_prefix_join, op6_bpe_chunks, op7_parse_dedup, op8_delta_rollups, op9_best_fit_packing, op10_ordinal_quality)
}
SQL = {"op2_secret_ownership": secrets.SQL}
