from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from . import syntax as S

QUERIES = {
    "p7_found": lambda s, d: S.checked(table(s, d, "source_files")).filter(F.col("error").isNotNull()).select("file_id"),
    "p7_rates": lambda s, d: S.rates(table(s, d, "source_files")),
}
SQL: dict = {}
