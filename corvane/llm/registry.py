"""Queries and oracle SQL of the subpackage."""

from __future__ import annotations

from .bpe import op10_bpe
from .chat import OP6_SQL, op6_chat
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .language import op4_language
from .minhash import OP8_SQL, op8_minhash
from .mixing import OP3_SQL, op3_mixing
from .quality import op2_quality
from .substrings import OP9_SQL, op9_substrings
from .topk import OP7_SQL, op7_topk
from .toxicity import op5_toxicity


def queries() -> dict:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_quality": op2_quality,
        "op3_mixing": op3_mixing,
        "op4_language": op4_language,
        "op5_toxicity": op5_toxicity,
        "op6_chat": op6_chat,
        "op7_topk": op7_topk,
        "op8_minhash": op8_minhash,
        "op9_substrings": op9_substrings,
        "op10_bpe": op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op3_mixing": OP3_SQL,
        "op6_chat": OP6_SQL,
        "op7_topk": OP7_SQL,
        "op8_minhash": OP8_SQL,
        "op9_substrings": OP9_SQL,
    }
