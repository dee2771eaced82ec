"""Registered queries: each runs one feature over whole tables, with DuckDB SQL for the same result."""

from __future__ import annotations

import importlib

from skyfold.catalog.base import ORACLES, QUERIES

# Importing a module registers its queries.
for _name in ("relational", "reports", "ordered", "quality", "domain", "modelling", "training", "endtoend"):
    importlib.import_module(f"skyfold.catalog.{_name}")

__all__ = ["ORACLES", "QUERIES"]
