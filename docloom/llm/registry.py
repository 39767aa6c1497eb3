"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import oracles
from .chat import op9
from .decontaminate import op10
from .html import op4
from .lm_score import op1
from .packing import op7
from .pii import op3
from .quality import op2
from .recompress import op6
from .sharding import op5
from .simhash import op8

QUERIES = {
    "op1_lm_score": op1,
    "op2_quality_rules": op2,
    "op3_pii": op3,
    "op4_wrapper_induction": op4,
    "op5_rendezvous_sharding": op5,
    "op6_recompression": op6,
    "op7_bestfit_packing": op7,
    "op8_simhash": op8,
    "op9_chat_format": op9,
    "op10_decontamination": op10,
}

ORACLE_SQL: dict[str, str] = {
    "op5_rendezvous_sharding": oracles.OP5,
    "op6_recompression": oracles.OP6,
    "op9_chat_format": oracles.OP9,
    "op10_decontamination": oracles.OP10,
}
