"""Training-data operators: thirteen corpus operators and their registered queries.

Nothing else in the library imports this subpackage.  Its modules are imported
when their queries are asked for, so that a Python worker loads only what its
function needs.
"""

from importlib import import_module

_MODULES = ("near_dedup", "sharding", "warc", "decontaminate", "secrets", "media", "toxicity", "pages_text", "mixing", "lm_score", "simhash", "lexical_search", "centroids")


def _each():
    return [import_module(f".{m}", __name__) for m in _MODULES]


def queries():
    """All registered queries of the subpackage, by name."""
    return {name: fn for m in _each() for name, fn in m.QUERIES.items()}


def oracle_sql():
    """DuckDB SQL for the queries that SQL can express."""
    return {name: sql for m in _each() for name, sql in m.ORACLE_SQL.items()}
