"""Registered queries and the SQL that states what each returns."""

from __future__ import annotations

import importlib

from .registry import ORACLE_SQL, QUERIES

for _name in ("events", "graph", "planes", "features", "models", "more"):
    importlib.import_module(f"{__package__}.queries_{_name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
