from __future__ import annotations

from ..session import table
from . import secrets as S

QUERIES = {
    "p2_found": lambda s, d: S.found_lines(table(s, d, "chunks")),
    "p2_redacted": lambda s, d: S.find(table(s, d, "chunks")).select("chunk_id", "redacted").distinct(),
    "p2_embeddings": lambda s, d: S.tainted_embeddings(table(s, d, "chunks"), table(s, d, "chunk_embeddings")),
}
SQL: dict = {}
