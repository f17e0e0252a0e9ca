"""Names of the library's queries, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

from larder.sources.batches import bounded

MODULES = ("grocery", "scalars", "events", "library", "nutrition", "extraction", "streams", "sharing", "posts")


def queries() -> dict:
    out = {}
    for name in MODULES:
        out |= {k: bounded(q) for k, q in import_module(f"larder.plans.{name}").QUERIES.items()}
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in MODULES:
        out |= import_module(f"larder.plans.{name}").ORACLE_SQL
    return out
