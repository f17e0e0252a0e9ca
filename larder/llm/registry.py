"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from .staging import small_batches

MODULES = ("bpe", "language", "chat", "simhash", "pii", "decontaminate", "html", "neighbours", "urls", "repeats", "infill", "centroids", "packing")


def bounded(query):
    """The query, in a session whose Arrow batches are small."""

    @wraps(query)
    def run(spark, sf_dir):
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    out = {}
    for name in MODULES:
        out |= {k: bounded(q) for k, q in import_module(f"larder.llm.{name}").QUERIES.items()}
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in MODULES:
        out |= getattr(import_module(f"larder.llm.{name}"), "ORACLE_SQL", {})
    return out
