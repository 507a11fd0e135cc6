"""Hash rollups from chunks to files, communities and repositories, and what changed between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ordered(key: list[str], hash_col: str) -> Column:
    """SHA-256 of the hashes, one to a line, in the order of the key; of the empty text where there are none."""
    rows = F.array_sort(F.collect_list(F.struct(*key, F.col(hash_col).alias("_h"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["_h"]), "\n"), 256)


def file_hashes(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(repo_id, file_id, path, hash); a file's chunks are its own parts."""
    c = chunks.select("file_id", F.coalesce("line_start", F.lit(-1)).alias("s"), F.coalesce("line_end", F.lit(-1)).alias("e"), "chunk_type", "content_hash")
    rolled = c.groupBy("file_id").agg(_ordered(["s", "e", "chunk_type"], "content_hash").alias("h"))
    return files.select("repo_id", "file_id", "path").join(rolled, "file_id", "left").select("repo_id", "file_id", "path", F.coalesce("h", F.sha2(F.lit(""), 256)).alias("hash"))


def community_hashes(members: DataFrame, nodes: DataFrame, hashes: DataFrame) -> DataFrame:
    """(community_id, hash) over the distinct files of the members, by path and hash."""
    at = members.join(nodes.filter("file_path is not null").select("node_id", F.col("file_path").alias("path")), "node_id").select("community_id", "repo_id", "path").distinct()
    rows = at.join(hashes.select("repo_id", "path", "hash").distinct(), ["repo_id", "path"]).select("community_id", "path", "hash").distinct()
    return rows.groupBy("community_id").agg(_ordered(["path"], "hash").alias("hash"))


def root_hashes(hashes: DataFrame) -> DataFrame:
    """(repo_id, hash): over the files by path and hash, in two levels so that no repository is gathered whole: the
    paths' hash buckets first, then the buckets."""
    bucket = F.substring(F.sha2("path", 256), 1, 2)
    low = hashes.groupBy("repo_id", bucket.alias("b")).agg(_ordered(["path"], "hash").alias("h"))
    return low.groupBy("repo_id").agg(_ordered(["b"], "h").alias("hash"))


def changed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys whose hash is new or differs; what was removed is not reported."""
    return new.join(old.select(key, F.col("hash").alias("was")), key, "left").filter(~F.col("hash").eqNullSafe(F.col("was"))).select(key)


def blast_radius(changed_ids: DataFrame, members: DataFrame) -> DataFrame:
    """Changed communities of two members or more, with their size."""
    sizes = members.groupBy("community_id").agg(F.count(F.lit(1)).alias("size")).filter("size >= 2")
    return sizes.join(changed_ids, "community_id", "left_semi")
