"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import incremental as I
from ..session import kept, table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return I.pending_chunks(table(spark, d, "chunks"), table(spark, d, "run_chunks"), table(spark, d, "analysis_runs"), kept(spark, "pending-chunks", d))


def p4_plan(spark: SparkSession, d: str) -> DataFrame:
    return I.run_plan(*(table(spark, d, t) for t in ("repositories", "chunks", "run_chunks", "analysis_runs")), kept(spark, "pending-chunks", d))


_PENDING = """
  fin AS (SELECT DISTINCT run_id FROM analysis_runs WHERE status = 'completed'),
  last AS (SELECT chunk_id, max_by(lower(content_hash), written_at) AS h FROM run_chunks
           WHERE run_id IN (SELECT run_id FROM fin) GROUP BY chunk_id),
  cur AS (SELECT DISTINCT chunk_id, repo_id, coalesce(lower(content_hash), sha256(content)) AS h FROM chunks),
  todo AS (SELECT DISTINCT c.chunk_id, c.repo_id FROM cur c LEFT JOIN last l ON l.chunk_id = c.chunk_id
           WHERE l.h IS NULL OR l.h <> c.h)
"""

QUERIES = {"p4_found": p4_found, "p4_plan": p4_plan}
SQL = {
    "p4_found": f"WITH {_PENDING} SELECT chunk_id FROM todo",
    "p4_plan": f"""WITH {_PENDING}
      SELECT r.repo_id, r.current_commit_sha,
             r.current_commit_sha IN (SELECT commit_sha FROM analysis_runs a WHERE a.repo_id = r.repo_id AND status = 'completed')
               IS TRUE AS commit_seen,
             CAST((SELECT count(*) FROM todo t WHERE t.repo_id = r.repo_id) AS BIGINT) AS pending
      FROM (SELECT DISTINCT repo_id, current_commit_sha FROM repositories) r""",
}
