"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .ann import op2_kmeans_tree_search
from .chat import OP9_SQL, op9_chat_formatting
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .html_text import op7_html_extraction
from .kneser_ney import op5_quality_classifier
from .line_dedup import OP10_SQL, op10_line_dedup
from .simhash import op6_simhash_near_dedup
from .packing import op4_best_fit_packing
from .pieces import op3_sentencepiece_sampling
from .sharding import op1_kd_sharding


def queries() -> dict:
    return {
        "op1_kd_sharding": op1_kd_sharding,
        "op2_kmeans_tree_search": op2_kmeans_tree_search,
        "op3_sentencepiece_sampling": op3_sentencepiece_sampling,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_simhash_near_dedup": op6_simhash_near_dedup,
        "op7_html_extraction": op7_html_extraction,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_line_dedup": op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": OP8_SQL, "op9_chat_formatting": OP9_SQL, "op10_line_dedup": OP10_SQL}
