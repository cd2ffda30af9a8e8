"""Registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("structure", "graph", "pipeline", "reads")


def all_queries() -> dict:
    found: dict = {}
    for m in MODULES:
        found |= import_module(f"{__name__}.{m}").QUERIES
    return found


def all_sql() -> dict:
    found: dict = {}
    for m in MODULES:
        found |= import_module(f"{__name__}.{m}").SQL
    return found
