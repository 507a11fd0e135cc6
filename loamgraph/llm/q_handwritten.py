from __future__ import annotations

from ..session import table
from . import handwritten as H


def _machine(s, d):
    return H.machine_files(*(table(s, d, t) for t in ("source_files", "indexing_config", "library_files", "repositories")))


QUERIES = {
    "p6_found": lambda s, d: _machine(s, d).select("file_id"),
    "p6_signs": _machine,
    "p6_shared": lambda s, d: H.shared_subtrees(table(s, d, "source_files")),
}
SQL: dict = {}
