"""Every query of the engine's own operators, with equivalent SQL."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = ("relational", "commitments", "text", "graph", "vectors", "ingest", "stream", "reads", "writes", "intent", "ontology", "retrieval", "policy", "answers", "surface")


def _load():
    for name in MODULES:
        import_module(f"{__package__}.queries.{name}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)
