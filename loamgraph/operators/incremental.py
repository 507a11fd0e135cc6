"""Problem 4: the chunks that the next run of each repository must process.

The state that finished runs left behind and the chunks as they are now are two versions of one ``VersionedTable``
(columns chunk_id, content_hash), the answer is the table's record delta between them.  The table is kept from run to
run: a version is made by writing only the buckets whose digest no earlier version had.  The answer is a versioned table
too, of the same buckets; its commits name the two versions they were made from, so a run makes only the buckets anew
whose files are others than in those versions, and none if none is.  A run that dies leaves the last commit, and the
next one does what is missing.

Defined results: a run with several log rows is finished if any is completed; rows of unknown runs, of failed
runs and of runs that never ended do not count; of equal ``written_at`` the greater hash counts; hashes compare in
lower case; a null hash in chunks is the SHA-256 of content (null content: of the empty text); rows with a null
chunk_id are left out; repeated rows count once; late rows count by ``written_at``; a chunk_id with several
different hashes in chunks is a case if one of them is new; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .versioned import VersionedTable


def finished_runs(analysis_runs: DataFrame) -> DataFrame:
    return analysis_runs.filter(F.col("status") == "completed").select("run_id").distinct()


def processed_state(run_chunks: DataFrame, analysis_runs: DataFrame) -> DataFrame:
    """chunk_id and the hash that the latest finished run wrote for it."""
    rows = run_chunks.select("run_id", "chunk_id", F.lower("content_hash").alias("content_hash"), "written_at").filter("chunk_id is not null")
    return (
        rows.join(finished_runs(analysis_runs), "run_id", "left_semi")
        .groupBy("chunk_id")
        .agg(F.max(F.struct("written_at", "content_hash")).alias("last"))
        .select("chunk_id", F.col("last.content_hash").alias("content_hash"))
    )


def current_state(chunks: DataFrame) -> DataFrame:
    digest = F.coalesce(F.lower("content_hash"), F.sha2(F.coalesce(F.col("content"), F.lit("")), 256))
    return chunks.filter("chunk_id is not null").select("chunk_id", digest.alias("content_hash")).distinct()


def pending_chunks(chunks: DataFrame, run_chunks: DataFrame, analysis_runs: DataFrame, kept: str | None = None) -> DataFrame:
    """(chunk_id) to process.  ``kept``: folder of the tables kept between runs; by default a new one."""
    spark = chunks.sparkSession
    root = kept or scratch(spark, "chunk-state")
    state, answer = VersionedTable(spark, f"{root}/state", ["chunk_id"]), VersionedTable(spark, f"{root}/pending", ["chunk_id"])
    answer.buckets = state.buckets
    before = state.refresh(processed_state(run_chunks, analysis_runs), {"of": "finished runs"})
    after = state.refresh(current_state(chunks), {"of": "chunks"})
    last = answer.latest()
    touched = None
    if last >= 0:
        seen = answer.commit_info(last)["meta"]
        touched = sorted(set(state.files_changed(seen["before"], before)) | set(state.files_changed(seen["after"], after)))
    if touched != []:
        delta = state.changes(before, after, touched)
        new = delta.filter("_vt_change = 'insert'").select("chunk_id").distinct() if "chunk_id" in delta.columns else spark.createDataFrame([], "chunk_id string")
        answer.replace_buckets(new, touched, {"before": before, "after": after})
    out = answer.snapshot()
    return out.select("chunk_id") if "chunk_id" in out.columns else spark.createDataFrame([], "chunk_id string")


def run_plan(repositories: DataFrame, chunks: DataFrame, run_chunks: DataFrame, analysis_runs: DataFrame, kept: str | None = None) -> DataFrame:
    """Per repository: chunks to process, and whether a finished run has seen its present commit."""
    todo = (
        pending_chunks(chunks, run_chunks, analysis_runs, kept)
        .join(chunks.select("chunk_id", "repo_id").distinct(), "chunk_id")
        .groupBy("repo_id")
        .agg(F.count(F.lit(1)).alias("pending"))
    )
    seen = analysis_runs.filter("status = 'completed'").select("repo_id", "commit_sha").distinct().withColumn("seen", F.lit(True))
    repos = repositories.select("repo_id", "current_commit_sha").distinct()
    return (
        repos.join(seen.withColumnRenamed("commit_sha", "current_commit_sha"), ["repo_id", "current_commit_sha"], "left")
        .join(todo, "repo_id", "left")
        .select(
            "repo_id",
            "current_commit_sha",
            F.coalesce("seen", F.lit(False)).alias("commit_seen"),
            F.coalesce("pending", F.lit(0)).cast("long").alias("pending"),
        )
    )
