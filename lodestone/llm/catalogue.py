"""All named queries of the subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("conversations", "truncation", "packing", "leakage", "language", "privacy")


def _modules():
    return [import_module(f"lodestone.llm.{m}") for m in MODULES]


def queries():
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in _modules() for k, s in getattr(m, "SQL", {}).items()}
