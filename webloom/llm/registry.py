"""Queries of the operators and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op5_license_scan": "license_scan",
    "op1_html_density": "html_density",
    "op6_byte_bpe": "bpe",
    "op7_token_counts": "token_scan",
    "op2_vector_sharding": "sharding",
    "op9_imatch_fingerprints": "imatch",
    "op10_containment_near_dup": "containment",
    "op3_best_fit_packing": "bestfit",
    "op4_ppm_langid": "ppm_langid",
    "op8_exact_dedup": "golomb_dedup",
}


def queries() -> dict:
    return {name: import_module(f".{module}", __package__).query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f".{module}", __package__), "SQL", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
