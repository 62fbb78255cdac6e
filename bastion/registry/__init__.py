"""Registered queries (Spark side) and their DuckDB oracles, keyed by SURVEY §2 IDs."""

from __future__ import annotations

from . import access, evaluation, guard, monitor, pipelines, vectors

MODULES = [guard, access, monitor, evaluation, vectors, pipelines]


def queries():
    out = {}
    for m in MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in MODULES:
        out.update(m.ORACLE)
    return out
