"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .language_id import op2_language_id
from .media import op3_media
from .oracles import OP8, OP9, OP10
from .packing import op5_packing
from .quality_rules import op6_quality_rules
from .rule_ensemble import op7_quality_classifier
from .secret_scan import op4_secrets
from .sentence_pieces import op1_sentencepiece
from .sharding import op9_sharding
from .shingle_join import op8_shingle_join
from .suffix_dedup import op10_suffix_dedup

QUERIES = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_language_id, op3_media, op4_secrets, op5_packing, op6_quality_rules, op7_quality_classifier, op8_shingle_join, op9_sharding, op10_suffix_dedup)
}
#: sentencepiece and BPE ids, models, digests of stored forms and spans by look-around are beyond DuckDB's SQL.
SQL: dict[str, str] = {"op8_shingle_join": OP8, "op9_sharding": OP9, "op10_suffix_dedup": OP10}
