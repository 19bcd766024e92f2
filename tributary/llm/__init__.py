"""Operators for preparing training text. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from .chat_format import OP2_SQL, op2_chat_format
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .line_dedup import op10_line_dedup
from .pack import op9_best_fit_pack
from .pii import PII_BASE_SQL, op1_pii, pii_base_counts
from .secret_scan import SECRET_BASE_SQL, op4_secret_scan, secret_base_counts
from .simhash_dedup import op3_simhash_dedup
from .source_mix import OP6_SQL, op6_source_mix
from .toxicity import op5_toxicity
from .vector_search import op7_vector_search

QUERIES = {
    "op1_pii": op1_pii,
    "op2_chat_format": op2_chat_format,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_toxicity": op5_toxicity,
    "op6_source_mix": op6_source_mix,
    "op7_vector_search": op7_vector_search,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_best_fit_pack": op9_best_fit_pack,
    "op10_line_dedup": op10_line_dedup,
    # What SQL can say of op1 and op4.
    "pii_base_counts": pii_base_counts,
    "secret_base_counts": secret_base_counts,
}

ORACLES = {
    "op2_chat_format": OP2_SQL,
    "op6_source_mix": OP6_SQL,
    "op8_exact_dedup": OP8_SQL,
    "pii_base_counts": PII_BASE_SQL,
    "secret_base_counts": SECRET_BASE_SQL,
}
