"""The graph's relations as versioned tables: read together, written together.

Every relation is a ``VersionedTable``; a write is the next snapshot of some of them (``operators.writes``), of which only
the buckets that differ are written.  A commit of the whole is one row in ``state``: the version of every table, so a
reader never sees half a write, and a job that dies leaves the last state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .operators import embedding as E
from .operators import writes as W
from .operators.versioned import VersionedTable

#: Relation -> (schema, key).
RELATIONS = {
    "repositories": ("repo_id string, name string, root_path string, remote_url string, current_commit_sha string, created_at timestamp, updated_at timestamp", ["repo_id"]),
    "runs": ("run_id string, repo_id string, commit_sha string, status string, error string, started_at timestamp, finished_at timestamp", ["run_id"]),
    "files": ("file_id string, repo_id string, path string, content_hash string", ["repo_id"]),
    "nodes": ("node_id string, repo_id string, kind string, stable_id string, name string, file_path string, line_start int, line_end int, metadata string", ["node_id"]),
    "edges": ("repo_id string, source string, target string, kind string, cost double, confidence double, metadata string", ["source"]),
    "chunks": ("chunk_id string, repo_id string, file_path string, node_id string, chunk_type string, content string, content_hash string, line_start int, line_end int, metadata string", ["chunk_id"]),
    "embeddings": ("embedding_id string, chunk_id string, provider string, model_id string, dimensions int, content_hash string, embedding array<float>", ["chunk_id"]),
    "communities": ("community_id string, repo_id string, label string, subtree_hash string, summary string, summary_hash string", ["community_id"]),
    "members": ("community_id string, repo_id string, node_id string", ["community_id"]),
    "summary_cache": ("hash string, summary string", ["hash"]),
    "projects": ("project_id string, name string", ["project_id"]),
    "project_members": ("project_id string, repo_id string, alias string, linked_hash string", ["project_id"]),
    "links": ("project_id string, kind string, source string, target string, total long, names string, confidence double", ["project_id"]),
}
GRAPH = ("files", "nodes", "edges", "chunks", "embeddings")


class GraphStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = {n: VersionedTable(spark, f"{self.root}/{n}", key, buckets) for n, (_, key) in RELATIONS.items()}
        self.state = VersionedTable(spark, f"{self.root}/state", ["relation"], 1)

    def versions(self) -> dict[str, int]:
        """Version of every relation in the last whole commit."""
        now = self.state.latest()
        return self.state.commit_info(now)["meta"]["versions"] if now >= 0 else {}

    def read(self, name: str) -> DataFrame:
        schema = RELATIONS[name][0]
        version = self.versions().get(name, -1)
        rows = self.tables[name].snapshot(version) if version >= 0 else None
        return self.spark.createDataFrame([], schema) if rows is None or rows.columns == ["_vt_none"] else rows

    def graph(self) -> dict[str, DataFrame]:
        return {n: self.read(n) for n in GRAPH}

    def write(self, relations: dict[str, DataFrame], note: str = "") -> dict[str, int]:
        """Commit the relations together."""
        versions = dict(self.versions())
        for name, df in relations.items():
            columns = [c.strip().split(" ")[0] for c in RELATIONS[name][0].split(", ")]
            versions[name] = self.tables[name].refresh(df.select(columns))
        self.state._commit(self.state.latest() + 1, self.state._write_manifest([]), {"versions": versions, "note": note})
        return versions

    # -- what the commands are made of -----------------------------------------------------------------------
    def open_run(self, repo_id: str, sha: str | None) -> str:
        run = uuid.uuid4().hex
        self.write({"runs": W.begin_run(run, repo_id, sha, self.read("runs"))}, "run begins")
        return run

    def close_run(self, run: str, status: str, error: str | None = None) -> None:
        self.write({"runs": W.finish_run(run, status, self.read("runs"), error)}, f"run {status}")

    def embed_missing(self, embedder: E.Embedder) -> int:
        """Embed what has no vector for its present content; how many.  An error leaves everything as it was."""
        made = E.embed_missing(self.read("chunks"), self.read("embeddings"), embedder)
        from .session import cut

        made = cut(made)  # an embedder is asked once
        n = made.count()
        if n:
            self.write({"embeddings": W.insert_embeddings(self.read("embeddings"), made)}, "vectors")
        return n

    def clean(self, repositories: DataFrame | None = None) -> None:
        """Delete the graph of the given repositories, or everything."""
        if repositories is None:
            self.write(W.clear({n: self.read(n) for n in RELATIONS}), "cleared")
        else:
            names = [n for n, (schema, _) in RELATIONS.items() if "repo_id string" in schema or n == "embeddings"]
            self.write(W.purge({n: self.read(n) for n in names}, repositories), "purged")
