from __future__ import annotations

from ..session import table
from . import mixing as M

QUERIES = {
    "p9_mix": lambda s, d: M.mix(table(s, d, "documents"), table(s, d, "mix_targets"), M.tokenizer_of(s)),
    "p9_report": lambda s, d: M.report(table(s, d, "documents"), table(s, d, "mix_targets"), M.tokenizer_of(s)),
}
SQL: dict = {}
