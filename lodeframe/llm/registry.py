"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op10_bpe
from .chat import OP5_SQL, op5_chat
from .decontaminate import op8_decontaminate
from .linededup import OP3_SQL, op3_lines
from .lmscore import op1_lm
from .neardup import op7_jaccard
from .quality import op4_quality
from .secrets import op6_secrets
from .sharding import op9_sharding
from .tokenfile import op2_tokens


def queries() -> dict:
    return {"op1_lm": op1_lm, "op2_tokens": op2_tokens, "op3_lines": op3_lines, "op4_quality": op4_quality, "op5_chat": op5_chat, "op6_secrets": op6_secrets, "op7_jaccard": op7_jaccard, "op8_decontaminate": op8_decontaminate, "op9_sharding": op9_sharding, "op10_bpe": op10_bpe}


def oracle_sql() -> dict[str, str]:
    return {"op3_lines": OP3_SQL, "op5_chat": OP5_SQL}
