"""The relations of the knowledge graph over the given tables: repeated rows dropped, null hashes filled.

Repeated rows are full copies, so a row is known by its id: what a query does not select is neither read nor compared,
and no text goes through a shuffle that needs the ids only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..session import table


def nodes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "graph_nodes").select("node_id", "repo_id", "kind", "stable_id", "name", "file_path", "line_start", "line_end", "metadata").dropDuplicates(["node_id"])


def files(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "source_files")
    return t.select("file_id", "repo_id", "path", "language", F.coalesce(F.lower("content_hash"), F.sha2("content", 256)).alias("content_hash"), "line_count", "content").dropDuplicates(["file_id"])


def chunks(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "chunks")
    return t.select(
        "chunk_id", "repo_id", "file_id", "node_id", "chunk_type", "content", F.coalesce(F.lower("content_hash"), F.sha2("content", 256)).alias("content_hash"), "line_start", "line_end", "metadata"
    ).dropDuplicates(["chunk_id"])


def embeddings(s: SparkSession, d: str) -> DataFrame:
    """Usable vectors only."""
    t = table(s, d, "chunk_embeddings")
    v = F.col("embedding")
    ok = v.isNotNull() & (F.size(v) == F.col("dimensions")) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    return t.filter(ok).select("embedding_id", "chunk_id", "provider", "model_id", "dimensions", F.lower("content_hash").alias("content_hash"), "embedding").dropDuplicates(["embedding_id"])


def communities(s: SparkSession, d: str) -> DataFrame:
    """The latest detection of every community."""
    t = table(s, d, "detected_communities").filter("member_node_ids is not null")
    w = Window.partitionBy("community_id").orderBy(F.desc("detected_at"), "detection_id")
    return (
        t.dropDuplicates(["detection_id"])
        .withColumn("r", F.row_number().over(w))
        .filter("r = 1")
        .select("community_id", "repo_id", "label", "size", F.array_distinct("member_node_ids").alias("members"), "internal_edges", "dominant_language")
    )


def members(s: SparkSession, d: str) -> DataFrame:
    return communities(s, d).select("community_id", "repo_id", F.explode("members").alias("node_id")).distinct()


def call_names(s: SparkSession, d: str) -> DataFrame:
    """(repo_id, node_id, callee): identifiers before a parenthesis in a node's chunks, one row each."""
    c = chunks(s, d).filter("node_id is not null")
    return c.select("repo_id", "node_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z_]\w*)\("), F.lit(1)))).alias("callee")).distinct()


def edges(s: SparkSession, d: str) -> DataFrame:
    """(repo_id, source, target, kind, cost, confidence): files define symbols; symbols call symbols.

    A call resolves to the symbol of that name in the caller's file, else to the first of the repository.
    """
    n = nodes(s, d)
    symbols = n.filter(~F.col("kind").isin("file", "dependency", "repository"))
    defines = n.filter("kind = 'file'").select("repo_id", "file_path", F.col("node_id").alias("source")).join(
        symbols.select("repo_id", "file_path", F.col("node_id").alias("target")), ["repo_id", "file_path"]
    )
    callable_ = symbols.filter(F.col("kind").isin("function", "method", "test"))
    local = callable_.groupBy("repo_id", "file_path", F.col("name").alias("callee")).agg(F.min_by("node_id", "stable_id").alias("local"))
    wide = callable_.groupBy("repo_id", F.col("name").alias("callee")).agg(F.min_by("node_id", "stable_id").alias("wide"))
    calls = (
        call_names(s, d)
        .join(n.select("node_id", "file_path"), "node_id")
        .join(local, ["repo_id", "file_path", "callee"], "left")
        .join(wide, ["repo_id", "callee"], "left")
        .select("repo_id", F.col("node_id").alias("source"), F.coalesce("local", "wide").alias("target"))
        .filter("target is not null and source <> target")
    )
    kind = lambda df, k: df.select("repo_id", "source", "target", F.lit(k).alias("kind"), F.lit(V.EDGE_WEIGHTS[k][0]).alias("cost"), F.lit(V.EDGE_WEIGHTS[k][1]).alias("confidence")).distinct()
    return kind(defines, "defines").unionByName(kind(calls, "calls"))


#: The same relations for the check in SQL.
SQL = r"""
nodes AS (SELECT DISTINCT node_id, repo_id, kind, stable_id, name, file_path, line_start, line_end, metadata FROM graph_nodes),
files AS (SELECT DISTINCT file_id, repo_id, path, language, coalesce(lower(content_hash), sha256(content)) AS content_hash, line_count, content FROM source_files),
chks AS (SELECT DISTINCT chunk_id, repo_id, file_id, node_id, chunk_type, content, coalesce(lower(content_hash), sha256(content)) AS content_hash, line_start, line_end, metadata FROM chunks),
vecs AS (SELECT DISTINCT embedding_id, chunk_id, provider, model_id, dimensions, lower(content_hash) AS content_hash, embedding FROM chunk_embeddings
         WHERE embedding IS NOT NULL AND len(embedding) = dimensions AND NOT list_bool_or([NOT isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])),
comms AS (SELECT community_id, repo_id, label, size, list_distinct(member_node_ids) AS members, internal_edges, dominant_language FROM
          (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY detected_at DESC, detection_id) AS r FROM (SELECT DISTINCT * FROM detected_communities WHERE member_node_ids IS NOT NULL)) WHERE r = 1),
mems AS (SELECT DISTINCT community_id, repo_id, unnest(members) AS node_id FROM comms),
callnames AS (SELECT DISTINCT repo_id, node_id, unnest(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) AS callee FROM chks WHERE node_id IS NOT NULL),
symbols AS (SELECT * FROM nodes WHERE kind NOT IN ('file', 'dependency', 'repository')),
calls AS (SELECT DISTINCT c.repo_id, c.node_id AS source, coalesce(l.n, w.n) AS target FROM callnames c JOIN nodes o ON o.node_id = c.node_id
          LEFT JOIN (SELECT repo_id, file_path, name, min_by(node_id, stable_id) AS n FROM symbols WHERE kind IN ('function', 'method', 'test') GROUP BY ALL) l
            ON l.repo_id = c.repo_id AND l.file_path = o.file_path AND l.name = c.callee
          LEFT JOIN (SELECT repo_id, name, min_by(node_id, stable_id) AS n FROM symbols WHERE kind IN ('function', 'method', 'test') GROUP BY ALL) w
            ON w.repo_id = c.repo_id AND w.name = c.callee),
edges AS (SELECT DISTINCT f.repo_id, f.node_id AS source, s.node_id AS target, 'defines' AS kind, 0.08::DOUBLE AS cost, 1.0::DOUBLE AS confidence
          FROM nodes f JOIN symbols s ON f.repo_id = s.repo_id AND f.file_path = s.file_path WHERE f.kind = 'file'
          UNION ALL SELECT repo_id, source, target, 'calls', 0.35, 0.7 FROM calls WHERE target IS NOT NULL AND source <> target)
"""
