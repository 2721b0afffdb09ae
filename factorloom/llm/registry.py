"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from .centroids import OP13_SQL, op13_centroid_clustering
from .chat_collapse import OP4_SQL, op4_chat_collapse
from .co_training import op9_quality_classifier
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .importance import OP11_SQL, op11_importance_resampling
from .language_id import op7_language_id
from .license_scan import op8_license_scan
from .line_dedup import op3_substring_dedup
from .mixing import op1_mixing
from .piece_tokens import op6_sentencepiece_round_trip
from .quality_rules import OP2_SQL, op2_quality_rules
from .secret_scan import op12_secret_scan
from .simhash import op5_simhash_near_dedup

_ALL = (
    op1_mixing, op2_quality_rules, op3_substring_dedup, op4_chat_collapse, op5_simhash_near_dedup,
    op6_sentencepiece_round_trip, op7_language_id, op8_license_scan, op9_quality_classifier, op10_exact_dedup,
    op11_importance_resampling, op12_secret_scan, op13_centroid_clustering,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {"op2_quality_rules": OP2_SQL, "op4_chat_collapse": OP4_SQL, "op10_exact_dedup": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op13_centroid_clustering": OP13_SQL}
