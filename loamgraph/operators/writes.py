"""Writes of the knowledge graph: each takes relations as they are and gives them as they become.

Nothing is changed in place: a write is the next snapshot of the relations it touches, and ``store.GraphStore`` commits
it, so that only the buckets that differ are written.  All of them work on any number of repositories at once.

A *graph* is a dict of relations: files (file_id, repo_id, path, ...), nodes (node_id, repo_id, kind, stable_id, name,
file_path, line_start, line_end, metadata), edges (repo_id, source, target, kind, cost, confidence, metadata), chunks
(chunk_id, repo_id, file_path, node_id, chunk_type, content, content_hash, line_start, line_end, metadata) and embeddings
(embedding_id, chunk_id, provider, model_id, dimensions, content_hash, embedding).

Defined results: repeated rows of a batch count once; a null hash never serves another chunk; deleting a file deletes
its nodes, every edge that touches them, its chunks and their vectors; shared nodes (without a file) stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

IDENTITY = ["provider", "model_id", "dimensions"]


def _only(df: DataFrame, key: str | list[str], of: DataFrame, how: str) -> DataFrame:
    key = [key] if isinstance(key, str) else key
    return df.join(of.select(*key).distinct(), key, how)


def upsert_repositories(old: DataFrame, new: DataFrame) -> DataFrame:
    """By root path: a known repository keeps its id and creation time.  new: as old."""
    o = old.select("root_path", *[F.col(c).alias(f"o_{c}") for c in old.columns if c != "root_path"])
    n = new.groupBy("root_path").agg(F.max_by(F.struct(*[c for c in new.columns if c != "root_path"]), "updated_at").alias("n"))
    keep = {"repo_id", "created_at"}
    col = lambda c: (F.coalesce(f"o_{c}", f"n.{c}") if c in keep else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o_{c}"))).alias(c)
    return o.join(n, "root_path", "full_outer").select(*["root_path" if c == "root_path" else col(c) for c in old.columns])


def saved_embeddings(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """One vector per repository, content and model."""
    has = chunks.filter("content_hash is not null").select("chunk_id", "repo_id", F.lower("content_hash").alias("hash")).distinct()
    rows = embeddings.select("embedding_id", "chunk_id", *IDENTITY, "embedding").join(has, "chunk_id")
    return rows.groupBy("repo_id", "hash", *IDENTITY).agg(F.min_by("embedding", "embedding_id").alias("embedding"))


def reattached(saved: DataFrame, chunks: DataFrame) -> DataFrame:
    """Saved vectors on new chunks of the same content."""
    rows = chunks.filter("content_hash is not null").select("chunk_id", "repo_id", F.lower("content_hash").alias("hash")).distinct().join(saved, ["repo_id", "hash"])
    name = F.concat_ws(":", "chunk_id", *IDENTITY, "hash")
    return rows.select(T.uuid5(name).alias("embedding_id"), "chunk_id", *IDENTITY, F.col("hash").alias("content_hash"), "embedding")


def replace_index(graph: dict[str, DataFrame], batch: dict[str, DataFrame], repositories: DataFrame) -> dict[str, DataFrame]:
    """The graph with everything of the given repositories replaced by the batch; vectors move to chunks of the same
    content."""
    out = {}
    for name in ("files", "nodes", "edges", "chunks"):
        out[name] = _only(graph[name], "repo_id", repositories, "left_anti").unionByName(batch[name].dropDuplicates(), allowMissingColumns=True)
    gone = _only(graph["chunks"], "repo_id", repositories, "left_semi")
    moved = reattached(saved_embeddings(graph["embeddings"], gone), batch["chunks"])
    out["embeddings"] = _only(graph["embeddings"], "chunk_id", gone, "left_anti").unionByName(moved, allowMissingColumns=True)
    return out


def merged_metadata(old: Column, new: Column) -> Column:
    """Fields of both JSON objects; of equal names the new one's value."""
    kind = "map<string,variant>"
    a, b = (F.coalesce(F.from_json(F.coalesce(c, F.lit("{}")), kind), F.from_json(F.lit("{}"), kind)) for c in (old, new))
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b))


def upserted_nodes(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ids): by repository and stable id; a known node keeps its id, and its file and lines where it has any,
    takes kind and name, and has both metadata.  ids: (new_id, node_id)."""
    key = ["repo_id", "stable_id"]
    cols = ["node_id", "kind", "name", "file_path", "line_start", "line_end", "metadata"]
    first = lambda df, p: df.groupBy(*key).agg(F.min_by(F.struct(*cols), "node_id").alias(p))
    both = first(old, "o").join(first(new, "n"), key, "full_outer")
    pick = lambda c, a, b: F.coalesce(f"{a}.{c}", f"{b}.{c}").alias(c)
    meta = F.when(F.col("o").isNull(), F.col("n.metadata")).when(F.col("n").isNull(), F.col("o.metadata")).otherwise(merged_metadata(F.col("o.metadata"), F.col("n.metadata")))
    nodes = both.select(
        pick("node_id", "o", "n"), "repo_id", pick("kind", "n", "o"), "stable_id", pick("name", "n", "o"),
        *[pick(c, "o", "n") for c in ("file_path", "line_start", "line_end")], meta.alias("metadata"),
    )
    ids = new.select(*key, F.col("node_id").alias("new_id")).distinct().join(nodes.select(*key, "node_id"), key).select("new_id", "node_id").distinct()
    return nodes, ids


def merge_files(graph: dict[str, DataFrame], batch: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """The graph with the files at (repo_id, path) replaced by the batch: what hung on them goes, nodes that survive keep
    their ids, and the batch's edges and chunks go to the ids that nodes have in the end."""
    place = paths.select("repo_id", F.col("path").alias("file_path")).distinct()
    dead = _only(graph["nodes"], ["repo_id", "file_path"], place, "left_semi").select("node_id")
    kept_nodes = _only(graph["nodes"], ["repo_id", "file_path"], place, "left_anti")
    kept_edges = graph["edges"].join(dead.select(F.col("node_id").alias("source")).distinct(), "source", "left_anti").join(dead.select(F.col("node_id").alias("target")).distinct(), "target", "left_anti")
    gone = _only(graph["chunks"], ["repo_id", "file_path"], place, "left_semi").select("chunk_id")
    kept_chunks = _only(graph["chunks"], ["repo_id", "file_path"], place, "left_anti")
    # a chunk of another file that hung on a deleted node stays without a node
    kept_chunks = kept_chunks.join(dead.withColumn("dead", F.lit(True)).distinct(), "node_id", "left").withColumn("node_id", F.when(F.col("dead").isNull(), F.col("node_id"))).select(*graph["chunks"].columns)
    nodes, ids = upserted_nodes(kept_nodes, batch["nodes"])
    end = lambda c: ids.select(F.col("new_id").alias(c), F.col("node_id").alias(f"{c}_now"))
    edges = batch["edges"].dropDuplicates().join(end("source"), "source").join(end("target"), "target").filter("source_now <> target_now")
    edges = edges.drop("source", "target").withColumnsRenamed({"source_now": "source", "target_now": "target"})
    chunks = batch["chunks"].dropDuplicates().withColumnRenamed("node_id", "new_id").join(ids, "new_id", "left").drop("new_id")
    return {
        "files": graph["files"].join(paths.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti").unionByName(batch["files"].dropDuplicates(), allowMissingColumns=True),
        "nodes": nodes,
        "edges": kept_edges.unionByName(edges.select(*kept_edges.columns)),
        "chunks": kept_chunks.unionByName(chunks.select(*kept_chunks.columns)),
        "embeddings": _only(graph["embeddings"], "chunk_id", gone, "left_anti"),
    }


def replace_communities(old: DataFrame, detected: DataFrame, repositories: DataFrame) -> DataFrame:
    """Communities of the repositories as detected; those known before keep summary, summary_hash and subtree_hash, those
    that are gone are deleted.  Members and edges of communities are simply those of the detection."""
    carried = ["summary", "summary_hash", "subtree_hash"]
    others = _only(old, "repo_id", repositories, "left_anti")
    known = old.groupBy("community_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in carried])
    fresh = detected.select(*[c for c in detected.columns if c not in carried]).join(known, "community_id", "left")
    return others.unionByName(fresh, allowMissingColumns=True)


def with_hashes(rows: DataFrame, hashes: DataFrame, key: str, column: str) -> DataFrame:
    """New values of a hash column where there are any; hashes: (key, hash)."""
    new = hashes.groupBy(key).agg(F.max("hash").alias("_new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*rows.columns)


def checked_vector(vector: Column, dimensions: Column) -> Column:
    """The vector; an error where its size is another one than stated or a number is not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) == dimensions) & finite, vector).otherwise(F.raise_error(F.lit("a vector has another size than stated, or holds numbers that are not finite")).cast("array<float>"))


def insert_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by chunk, model and content; a vector that must not be used fails the job."""
    key = ["chunk_id", *IDENTITY, "content_hash"]
    fresh = new.select("embedding_id", *key, checked_vector(F.col("embedding"), F.col("dimensions")).alias("embedding")).dropDuplicates(key)
    keep = old.join(fresh.select(*key), key, "left_anti")
    return keep.unionByName(fresh, allowMissingColumns=True)


def save_summaries(communities: DataFrame, cache: DataFrame, made: DataFrame, tag: str = "-sum3") -> tuple[DataFrame, DataFrame]:
    """(communities, cache) with the summaries made: (community_id, hash, summary)."""
    new = made.groupBy("community_id").agg(F.max(F.struct("hash", "summary")).alias("m"))
    out = communities.join(new, "community_id", "left").withColumns({"summary": F.coalesce("m.summary", "summary"), "summary_hash": F.coalesce(F.concat("m.hash", F.lit(tag)), "summary_hash")})
    entries = made.groupBy("hash").agg(F.min("summary").alias("summary"))
    return out.select(*communities.columns), cache.join(entries.select("hash"), "hash", "left_anti").unionByName(entries, allowMissingColumns=True)


def summary_counts(hashes: DataFrame, summaries: DataFrame, cache: DataFrame, vectors: DataFrame, tag: str = "-sum3") -> DataFrame:
    """(community_id, hash, state): skipped (summary and vector are of the present hash), reused (the cache has the
    text) or pending (to be composed and embedded)."""
    rows = (
        hashes.join(summaries.select("community_id", "summary_hash"), "community_id", "left")
        .join(vectors.select("community_id").distinct().withColumn("has", F.lit(True)), "community_id", "left")
        .join(cache.select("hash").distinct().withColumn("cached", F.lit(True)), "hash", "left")
    )
    fresh = F.col("summary_hash").eqNullSafe(F.concat("hash", F.lit(tag))) & F.col("has").isNotNull()
    return rows.select("community_id", "hash", F.when(fresh, "skipped").when(F.col("cached").isNotNull(), "reused").otherwise("pending").alias("state"))


def begin_run(run_id: str, repo_id: str, sha: str | None, runs: DataFrame) -> DataFrame:
    row = runs.sparkSession.range(1).select(F.lit(run_id).alias("run_id"), F.lit(repo_id).alias("repo_id"), F.lit(sha).cast("string").alias("commit_sha"), F.lit("running").alias("status"), F.lit(None).cast("string").alias("error"))
    return runs.unionByName(row.withColumn("started_at", F.current_timestamp().cast(runs.schema["started_at"].dataType)), allowMissingColumns=True)


def finish_run(run_id: str, status: str, runs: DataFrame, error: str | None = None) -> DataFrame:
    """The log with the run's end: its last row once more in its final state."""
    last = runs.filter(F.col("run_id") == run_id).orderBy(F.desc("started_at")).limit(1)
    end = last.withColumns({"status": F.lit(status), "error": F.lit(error).cast("string"), "finished_at": F.current_timestamp().cast(runs.schema["finished_at"].dataType)})
    return runs.unionByName(end.select(*runs.columns))


def purge(graph: dict[str, DataFrame], repositories: DataFrame) -> dict[str, DataFrame]:
    """The graph without the given repositories; vectors go with their chunks."""
    out = {n: _only(df, "repo_id", repositories, "left_anti") for n, df in graph.items() if "repo_id" in df.columns}
    if "embeddings" in graph:
        out["embeddings"] = _only(graph["embeddings"], "chunk_id", _only(graph["chunks"], "repo_id", repositories, "left_semi"), "left_anti")
    return out


def clear(graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {n: df.limit(0) for n, df in graph.items()}


# -- projects ------------------------------------------------------------------------------------------------
def create_projects(projects: DataFrame, names: DataFrame) -> DataFrame:
    """Projects of new names are added; known ones stay as they are.  projects: (project_id, name)."""
    new = names.select("name").filter("name is not null").distinct().join(projects.select("name"), "name", "left_anti")
    return projects.unionByName(new.select(T.uuid5(F.concat(F.lit("project:"), F.col("name"))).alias("project_id"), "name"), allowMissingColumns=True)


def add_repositories(members: DataFrame, added: DataFrame) -> DataFrame:
    """(project_id, repo_id, alias, linked_hash): a repository that is in already takes the new alias."""
    key = ["project_id", "repo_id"]
    new = added.groupBy(*key).agg(F.max("alias").alias("n_alias"))
    return members.join(new, key, "full_outer").select(*key, F.coalesce("n_alias", "alias").alias("alias"), "linked_hash")


def set_linked(members: DataFrame, roots: DataFrame, project_id: str) -> DataFrame:
    """The members of a project are linked at their present root hashes; roots: (repo_id, hash)."""
    now = roots.select("repo_id", F.col("hash").alias("_now"))
    here = F.col("project_id") == project_id
    return members.join(now, "repo_id", "left").withColumn("linked_hash", F.when(here, F.col("_now")).otherwise(F.col("linked_hash"))).select(*members.columns)


def replace_links(links: DataFrame, project_id: str, new: DataFrame) -> DataFrame:
    return links.filter(F.col("project_id") != project_id).unionByName(new.withColumn("project_id", F.lit(project_id)).select(*links.columns))


def load_links(links: DataFrame, project_id: str | None = None) -> DataFrame:
    """Links, the surest first, then by kind, source and target."""
    rows = links if project_id is None else links.filter(F.col("project_id") == project_id)
    return rows.orderBy(F.desc("confidence"), "kind", "source", "target")


def projects_of(members: DataFrame, projects: DataFrame, repositories: DataFrame) -> DataFrame:
    """(repo_id, project_id, name): the projects that contain the repositories."""
    return _only(members, "repo_id", repositories, "left_semi").join(projects.select("project_id", "name"), "project_id").select("repo_id", "project_id", "name").distinct()


def best_first(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of every key in the given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")
