"""The queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

import importlib

#: query name: (module, function)
NAMES = {
    "op1_ann": ("ann", "op1_ann"),
    "op2_language_id": ("langid", "op2_language_id"),
    "op3_simhash_dedup": ("simhash", "op3_simhash_dedup"),
    "op4_substring_dedup": ("substrings", "op4_substring_dedup"),
    "op5_decontaminate": ("decontam", "op5_decontaminate"),
    "op6_license_scan": ("license", "op6_license_scan"),
    "op7_mix": ("mix", "op7_mix"),
    "op8_toxicity": ("toxicity", "op8_toxicity"),
    "op9_quality": ("quality", "op9_quality"),
    "op10_line_dedup": ("linededup", "op10_line_dedup"),
}


def _lazy(module: str, name: str):
    def query(spark, sf_dir):
        return getattr(importlib.import_module(f"capweave.llm.{module}"), name)(spark, sf_dir)

    query.__name__ = name
    return query


def queries() -> dict:
    return {k: _lazy(*v) for k, v in NAMES.items()}


def oracle_sql() -> dict:
    from capweave.llm import sql

    return dict(sql.ORACLE)
