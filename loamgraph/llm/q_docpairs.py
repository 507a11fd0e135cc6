from __future__ import annotations

from ..session import table
from . import docpairs as D

QUERIES = {
    "p5_found": lambda s, d: D.pairs(table(s, d, "graph_nodes"), table(s, d, "chunks")).select("node_id").distinct(),
    "p5_pairs": lambda s, d: D.pairs(table(s, d, "graph_nodes"), table(s, d, "chunks")),
}
SQL: dict = {}
