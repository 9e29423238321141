"""All named queries of the core."""

from __future__ import annotations

from lodestone.plans import context, digest, facts, general, memory, search, store

MODULES = (general, search, context, facts, memory, store, digest)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.SQL.items()}


def flagship(spark, sf_dir):
    return search.bm25_topk(spark, sf_dir)
