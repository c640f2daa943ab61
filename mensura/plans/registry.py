"""Every registered query with its SQL; each group lives in a module of its own."""

from __future__ import annotations

import importlib

GROUPS: list[str] = ["verdict_queries", "measure_queries", "record_queries", "report_queries", "bookkeeping_queries", "split_queries", "source_queries", "model_queries"]


def _merged(attribute: str) -> dict:
    found: dict = {}
    for name in GROUPS:
        part = getattr(importlib.import_module(f"mensura.plans.{name}"), attribute)
        if clash := found.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        found.update(part)
    return found


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
