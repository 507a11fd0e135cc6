from __future__ import annotations

from ..session import table
from . import leakage as L

QUERIES = {
    "p8_found": lambda s, d: L.leaks(table(s, d, "documents"), table(s, d, "eval_items")),
    "p8_report": lambda s, d: L.leak_report(table(s, d, "documents"), table(s, d, "eval_items")),
}
SQL: dict = {}
