"""One registered query per operator, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from .decontamination import OP2_SQL, op2_decontamination
from .hard_negatives import op11_hard_negatives
from .language import op7_language
from .licences import op4_licences
from .packing import op6_packing
from .pii import op12_pii
from .quality_classifier import op9_quality_classifier
from .quality_rules import op10_quality_rules
from .repair import op13_repair
from .sharding import op1_sharding
from .simhash import op5_simhash
from .suffix_dedup import op3_suffix_dedup
from .token_counts import op8_token_counts

QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_decontamination, op3_suffix_dedup, op4_licences, op5_simhash, op6_packing, op7_language,
    op8_token_counts, op9_quality_classifier, op10_quality_rules, op11_hard_negatives, op12_pii, op13_repair)}
ORACLE_SQL: dict[str, str] = {"op2_decontamination": OP2_SQL}
