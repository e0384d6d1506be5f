"""Registered queries, one module per operator group."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    for found in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        yield importlib.import_module(f"{__name__}.{found.name}")


def all_queries() -> dict:
    return {name: fn for module in _modules() for name, fn in module.QUERIES.items()}


def all_sql() -> dict:
    return {name: sql for module in _modules() for name, sql in module.SQL.items()}
