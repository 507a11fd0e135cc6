"""All queries of the core, by name."""

from __future__ import annotations

import importlib

MODULES = ("catalog", "graph", "incremental", "lexical", "lookups", "reports", "retrieval", "sources", "workspace", "writes")


def collect(attr: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"{__package__}.{name}"), attr)
        if clash := out.keys() & part.keys():
            raise ValueError(f"queries named twice: {sorted(clash)}")
        out |= part
    return out
