"""The queries opN_<name> of this subpackage and the SQL that some can be held against."""

from __future__ import annotations

from .alignment import op11_alignment
from .chat import OP4_SQL, op4_chat_formatting
from .decontamination import OP10_SQL, op10_decontamination
from .jaccard import OP5_SQL, op5_jaccard_join
from .langid import op9_language_id
from .licenses import OP12_SQL, op12_license_scan
from .mixing import OP7_SQL, op7_mixing
from .quality import op6_quality
from .substrings import OP3_SQL, op3_substring_dedup
from .tokens import op2_token_counts
from .topk import OP1_SQL, op1_top_k_search
from .toxicity import op8_toxicity
from .trie import OP13_SQL, op13_prefix_trie

QUERIES = {
    "op1_top_k_search": op1_top_k_search,
    "op2_token_counts": op2_token_counts,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_alignment": op11_alignment,
    "op12_license_scan": op12_license_scan,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {"op1_top_k_search": OP1_SQL, "op3_substring_dedup": OP3_SQL, "op4_chat_formatting": OP4_SQL, "op5_jaccard_join": OP5_SQL, "op7_mixing": OP7_SQL, "op10_decontamination": OP10_SQL, "op12_license_scan": OP12_SQL, "op13_prefix_trie": OP13_SQL}
