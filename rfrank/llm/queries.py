"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .alignment import op11_alignment
from .chat import OP9_SQL, op9_chat
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .html_text import op6_html_text
from .knn import OP3_SQL, op3_top_k
from .merkle import OP13_SQL, op13_merkle
from .mixing import OP1_SQL, op1_mix_sources
from .packing import op10_pack
from .pii import op5_pii
from .quality import op2_quality
from .secret_scan import op12_secrets
from .simhash import op8_simhash
from .substrings import op4_substring_dedup

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_quality": op2_quality,
    "op3_top_k": op3_top_k,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_pii": op5_pii,
    "op6_html_text": op6_html_text,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_simhash": op8_simhash,
    "op9_chat": op9_chat,
    "op10_pack": op10_pack,
    "op11_alignment": op11_alignment,
    "op12_secrets": op12_secrets,
    "op13_merkle": op13_merkle,
}
ORACLE_SQL = {"op1_mix_sources": OP1_SQL, "op3_top_k": OP3_SQL, "op7_exact_dedup": OP7_SQL, "op9_chat": OP9_SQL, "op13_merkle": OP13_SQL}
