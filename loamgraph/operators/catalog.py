"""Scans, lookups, counts and incremental bookkeeping over the graph's relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def in_folder(path: Column, folder: str) -> Column:
    """The folder itself or anything below it, whatever the case of letters."""
    f = folder.strip().removeprefix("./").strip("/").lower()
    return (F.lower(path) == f) | F.lower(path).startswith(f + "/")


def incident_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end among the ids, each once."""
    key = ids.select("node_id").distinct()
    out = edges.join(key.withColumnRenamed("node_id", "source"), "source", "left_semi")
    into = edges.join(key.withColumnRenamed("node_id", "target"), "target", "left_semi")
    return out.unionByName(into).distinct()


def graph_export(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every node with the number of its chunks, counted before the join."""
    n = chunks.filter("node_id is not null").groupBy("node_id").agg(F.count(F.lit(1)).alias("chunks"))
    return nodes.join(n, "node_id", "left").select("node_id", "repo_id", "kind", "name", F.coalesce("file_path", F.lit("")).alias("path"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))


def top_members(members: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The first k members of each community of two or more, by kind, name and stable_id; files left out."""
    sizes = members.groupBy("community_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    w = Window.partitionBy("community_id").orderBy("kind", "name", "stable_id")
    rows = members.join(sizes, "community_id").join(nodes.filter("kind <> 'file'").select("node_id", "kind", "name", "stable_id"), "node_id")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("community_id", "place", "kind", "name")


def dominant_community(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Per file the community (of two or more) with most of its nodes; ties to the smallest id."""
    big = members.groupBy("community_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("community_id")
    counts = (
        members.join(big, "community_id").join(nodes.filter("file_path is not null").select("node_id", "file_path"), "node_id")
        .groupBy("repo_id", "file_path", "community_id").agg(F.count(F.lit(1)).alias("c"))
    )
    best = counts.groupBy("repo_id", "file_path").agg(F.min(F.struct((-F.col("c")).alias("c"), "community_id")).alias("b"))
    return best.select("repo_id", "file_path", "b.community_id", (-F.col("b.c")).alias("members"))


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame, provider: str, model: str) -> DataFrame:
    """Chunks without a vector of the model for the content they have now."""
    have = embeddings.filter((F.col("provider") == provider) & (F.col("model_id") == model)).select("chunk_id", "content_hash")
    return chunks.select("chunk_id", "repo_id", "content_hash").join(have, ["chunk_id", "content_hash"], "left_anti")


def reusable_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Vectors that serve another chunk of the same content: (chunk_id, provider, model_id, embedding_id)."""
    per = embeddings.groupBy("content_hash", "provider", "model_id", "dimensions").agg(F.min("embedding_id").alias("embedding_id"))
    return chunks.select("chunk_id", "content_hash").join(per, "content_hash").select("chunk_id", "provider", "model_id", "embedding_id").distinct()


def merged_node(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by stable_id: the old id survives; lines stay where known; kind and name are the new ones."""
    o = old.select("repo_id", "stable_id", *[F.col(c).alias(f"o_{c}") for c in ("node_id", "kind", "name", "line_start", "line_end")])
    n = new.select("repo_id", "stable_id", *[F.col(c).alias(f"n_{c}") for c in ("node_id", "kind", "name", "line_start", "line_end")])
    pick = lambda c, first, then: F.coalesce(f"{first}_{c}", f"{then}_{c}").alias(c)
    return o.join(n, ["repo_id", "stable_id"], "full_outer").select(
        "repo_id", "stable_id", pick("node_id", "o", "n"), pick("kind", "n", "o"), pick("name", "n", "o"), pick("line_start", "o", "n"), pick("line_end", "o", "n")
    )


def without_files(edges: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges that remain when files are deleted: an edge goes with either end, from whatever file it comes."""
    gone = nodes.join(paths, ["repo_id", "file_path"], "left_semi").select("node_id")
    return edges.join(gone.withColumnRenamed("node_id", "source"), "source", "left_anti").join(gone.withColumnRenamed("node_id", "target"), "target", "left_anti")


def first_per_stable_id(nodes: DataFrame) -> DataFrame:
    w = Window.partitionBy("repo_id", "stable_id").orderBy("node_id")
    return nodes.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def chunks_like(chunks: DataFrame, files: DataFrame, patterns: list[str], limit: int | None = None) -> DataFrame:
    """Chunks whose content holds one of the patterns, in the order path, line, hash."""
    low = F.lower("content")
    rows = chunks.filter(T.contains_any(low, [p.lower() for p in patterns])).join(files.select("file_id", "path"), "file_id", "left")
    rows = rows.select(F.coalesce("path", F.lit("")).alias("path"), "line_start", "content_hash", "chunk_id")
    return rows.orderBy("path", F.asc_nulls_first("line_start"), "content_hash", "chunk_id").limit(limit) if limit else rows


def top_folders(files: DataFrame, k: int = 4) -> DataFrame:
    """Per repository the k commonest leading folders of up to two segments."""
    parts = F.split("path", "/")
    folder = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(2), F.size(parts) - 1)), "/"))
    counts = files.select("repo_id", folder.alias("folder")).filter("folder is not null").groupBy("repo_id", "folder").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("repo_id").orderBy(F.desc("n"), "folder")
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def last_run(runs: DataFrame) -> DataFrame:
    """The state each run ended in: completed over failed over running, as a failed run may complete later."""
    order = F.when(F.col("status") == "completed", 2).when(F.col("status") == "failed", 1).otherwise(0)
    return runs.groupBy("run_id", "repo_id").agg(F.max_by("status", order).alias("status"), F.max("finished_at").alias("finished_at"))
