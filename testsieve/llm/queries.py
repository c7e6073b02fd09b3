"""The registered queries of this folder: each applies one operator to its whole table.

Chat formatting, line dedup and secret scans are held against SQL (oracles.py). In tests/llm, digests, license scans, benchmark
decontamination, line dedup, secret scans and near-dedup are held against brute-force versions, chat formatting and BPE against
a version that goes event by event, the library and exact round trips, language ID and toxicity against held-out rows."""

from __future__ import annotations

from collections.abc import Callable

from .bpe import op3_bpe
from .chat import op1_chat_format
from .decontam import op5_decontam
from .digest import op2_rare_digest
from .langid import op6_lang_id
from .licenses import op4_license_scan
from .line_dedup import op7_line_dedup
from .oracles import oracle_sql
from .secrets import op8_secret_scan
from .simhash import op10_simhash_neardup
from .toxicity import op9_toxicity


def queries() -> dict[str, Callable]:
    found = [op1_chat_format, op2_rare_digest, op3_bpe, op4_license_scan, op5_decontam, op6_lang_id, op7_line_dedup, op8_secret_scan, op9_toxicity, op10_simhash_neardup]
    return {f.__name__: f for f in found}


__all__ = ["oracle_sql", "queries"]
