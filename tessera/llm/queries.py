"""The queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import quality, repair, resampling, secrets, url_filter
from .bpe import op8_bpe
from .dedup import op3_near_dedup
from .fingerprint import op4_fingerprints
from .language import op10_language_id
from .licenses import op2_license_scan
from .packing import op6_packing
from .quality import op5_quality_rules
from .repair import op11_conversation_repair
from .resampling import op13_importance_resampling
from .secrets import op12_secret_scan
from .token_counts import op1_token_counts
from .toxicity import op7_toxicity
from .url_filter import op9_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_license_scan, op3_near_dedup, op4_fingerprints, op5_quality_rules, op6_packing, op7_toxicity, op8_bpe, op9_url_filter,
        op10_language_id, op11_conversation_repair, op12_secret_scan, op13_importance_resampling,
    )
}
ORACLE_SQL = {
    "op5_quality_rules": quality.ORACLE_SQL, "op9_url_filter": url_filter.ORACLE_SQL, "op11_conversation_repair": repair.ORACLE_SQL,
    "op12_secret_scan": secrets.ORACLE_SQL, "op13_importance_resampling": resampling.ORACLE_SQL,
}
