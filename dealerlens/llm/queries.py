"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: Query -> module that holds it.
MODULES = {
    "op1_best_fit_packing": "packing",
    "op2_document_fingerprints": "fingerprint",
    "op3_source_mixing": "mixing",
    "op4_secret_scans": "secrets",
    "op5_lm_scoring": "kneser_ney",
    "op6_license_scans": "licenses",
    "op7_toxicity": "toxicity",
    "op8_exact_top_k": "topk",
    "op9_minhash_near_dedup": "near_dup",
    "op10_url_filters": "url_filter",
}


def queries() -> dict[str, Callable]:
    found = {name: getattr(importlib.import_module(f".{module}", __package__), name) for name, module in MODULES.items()}
    return found | {"pipeline": importlib.import_module("corpus_pipeline").run}


def oracle_sql() -> dict[str, str]:
    from . import mixing, topk, url_filter

    return {"op3_source_mixing": mixing.oracle(), "op8_exact_top_k": topk.OP8_SQL, "op10_url_filters": url_filter.oracle()}
