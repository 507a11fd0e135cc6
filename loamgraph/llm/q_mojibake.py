from __future__ import annotations

from ..session import table
from . import mojibake as M

QUERIES = {
    "p10_found": lambda s, d: M.evidence(table(s, d, "documents")).select("doc_id").distinct(),
    "p10_restored": lambda s, d: M.garbled(table(s, d, "documents")),
}
SQL: dict = {}
