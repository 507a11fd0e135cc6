"""Queries of the problems tagged llm."""

from __future__ import annotations

import importlib

#: Each has QUERIES and SQL.
MODULES = ("q_ann", "q_clusters", "q_docpairs", "q_handwritten", "q_leakage", "q_mixing", "q_mojibake", "q_secrets", "q_syntax")

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _part = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
