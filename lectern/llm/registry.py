"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

import importlib

#: (module, query) in the order of the operators.
QUERIES = [
    ("toxicity", "op1_toxicity"),
    ("packing", "op2_packing"),
    ("secret_scan", "op3_secret_scan"),
    ("line_dedup", "op4_line_dedup"),
    ("bpe", "op5_bpe"),
    ("embedding_dedup", "op6_embedding_dedup"),
    ("license_scan", "op7_license_scan"),
    ("minhash_dedup", "op8_minhash_dedup"),
    ("exact_dedup", "op9_exact_dedup"),
    ("quality", "op10_quality"),
    ("suffix_lm", "op11_suffix_lm"),
    ("zorder_layout", "op12_zorder_layout"),
    ("collocations", "op13_collocations"),
]


def _module(name: str):
    return importlib.import_module(f"{__package__}.{name}")


def queries() -> dict:
    return {query: getattr(_module(module), query) for module, query in QUERIES}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in dict.fromkeys(m for m, _ in QUERIES):
        out |= getattr(_module(module), "ORACLE_SQL", {})
    return out
