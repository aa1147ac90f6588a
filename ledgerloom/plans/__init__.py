"""Registered queries of the library: each with the DuckDB SQL of its result where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from .corpus import Session

MODULES = ["retrieval", "extraction", "relations", "graph", "rules", "sources", "drawings", "project", "analysis", "services", "statements", "matching"]


def _all():
    return {name: pair for m in MODULES for name, pair in import_module(f".{m}", __name__).QUERIES.items()}


def flagship(spark, sf_dir):
    return import_module(".retrieval", __name__).bm25_topk(spark, sf_dir)


def queries():
    """Queries by name; each takes (spark, folder of the tables)."""
    return {name: (lambda spark, folder, fn=fn: fn(Session(spark, folder), folder)) for name, (fn, _) in _all().items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
