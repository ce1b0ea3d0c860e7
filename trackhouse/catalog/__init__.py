"""Runnable queries over the given tables, one per operator, with SQL twins."""

from __future__ import annotations

from importlib import import_module

from trackhouse.catalog.base import ORACLES, QUERIES

MODULES = ("alignment", "scalars", "joins", "aggregates", "ordered", "tracks", "files")


def _load() -> None:
    for name in MODULES:
        import_module(f"trackhouse.catalog.{name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
