"""Queries over the given tables, each with the SQL that checks it.

The tables hold no macro series, so small adapters turn them into staging-shaped observations. Spark and SQL
sides build the same observations and then compute the result independently.
"""

from __future__ import annotations

from importlib import import_module

MODULES = ["series", "policy", "currency", "equity", "returns", "tables", "landing", "refreshes", "listings"]


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict:
    return _collect("ORACLES")


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged.update(getattr(import_module(f"tenorline.workload.{name}"), attribute))
    return merged
