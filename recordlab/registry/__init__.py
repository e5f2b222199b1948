"""Named queries over the test tables."""

from __future__ import annotations

MODULES = ("curation", "evaluation", "modelling", "values")


def _modules():
    from importlib import import_module

    return [import_module(f"recordlab.registry.{m}") for m in MODULES]


def all_queries():
    return {name: fn for m in _modules() for name, fn in m.QUERIES.items()}


def all_sql():
    return {name: sql for m in _modules() for name, sql in m.ORACLE.items()}
