"""The corpus operators' queries by name."""

from __future__ import annotations

from .decontam import op3_decontaminate
from .licenses import op10_licenses
from .lines import op6_line_dedup
from .packing import op2_pack
from .pii import op1_pii
from .quality import op7_quality
from .shards import op5_jump_shards
from .simhash import op4_simhash
from .substrings import op8_substrings
from .tokens import op9_token_files

_ALL = (
    op1_pii, op2_pack, op3_decontaminate, op4_simhash, op5_jump_shards,
    op6_line_dedup, op7_quality, op8_substrings, op9_token_files, op10_licenses,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    """SQL can't express these operators; tests/llm compares them with brute force."""
    return {}
