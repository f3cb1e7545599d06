"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .alignment import op11_token_alignment
from .chat import OP7_SQL, op7_chat_formatting
from .divergence import OP13_SQL, op13_source_divergence
from .html_text import op8_html_extraction
from .media import op9_media_columns
from .mixing import op2_mix_sources
from .packing import op5_best_fit_packing
from .quality import op1_quality_classifier
from .search import OP6_SQL, op6_exact_topk
from .simhash import op4_simhash_neardup
from .suffixes import op3_suffix_array_dedup
from .token_files import op12_token_files
from .toxicity import op10_toxicity

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_mix_sources": op2_mix_sources,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_simhash_neardup": op4_simhash_neardup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_exact_topk": op6_exact_topk,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_html_extraction": op8_html_extraction,
    "op9_media_columns": op9_media_columns,
    "op10_toxicity": op10_toxicity,
    "op11_token_alignment": op11_token_alignment,
    "op12_token_files": op12_token_files,
    "op13_source_divergence": op13_source_divergence,
}

#: Sizes are small whole tables; the others have brute-force tests instead.
ORACLE_SQL: dict[str, str] = {"op6_exact_topk": OP6_SQL, "op7_chat_formatting": OP7_SQL, "op13_source_divergence": OP13_SQL}
