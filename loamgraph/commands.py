"""The engine's commands as functions: analyze, add, query, feature-context, impact, stack, clean, stats, project.

Each takes a ``GraphStore`` and gives a DataFrame or a small dict of counts; nothing else is kept between calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import uuid5
from .operators import graph as G
from .operators import links as K
from .operators import merkle as M
from .operators import reports as P
from .operators import retrieval as Q
from .operators import stack as T
from .operators import summary as S
from .operators import writes as W
from .operators.catalog import dominant_community
from .operators.embedding import Embedder, embedded
from .operators.lookups import manifest_dependency
from .session import cut
from .sources import graph_rows as X
from .store import GraphStore

SUMMARIES = "community-summary"


def _file_hashes(store: GraphStore) -> DataFrame:
    f = store.read("files")
    c = store.read("chunks").withColumnRenamed("file_path", "path").join(f.select("repo_id", "path", "file_id"), ["repo_id", "path"])
    return M.file_hashes(f, c)


def _community_rows(store: GraphStore) -> tuple[DataFrame, DataFrame]:
    """(communities, members) as detected in the graph as it is; labels are the commonest leading folder and a member."""
    nodes, edges = store.read("nodes"), store.read("edges")
    # neither the repository nor what manifests declare holds code together
    code = nodes.filter((F.col("kind") != "repository") & ~manifest_dependency(F.col("kind"), F.col("stable_id")))
    ends = code.select("node_id")
    inner = edges.join(ends.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ends.withColumnRenamed("node_id", "target"), "target", "left_semi")
    found = cut(G.louvain(G.pair_weights(inner), code))
    members = found.select(uuid5(F.concat_ws(":", "repo_id", "label")).alias("community_id"), "repo_id", "node_id")
    named = members.join(nodes.select("node_id", "name", "kind", "stable_id", F.coalesce("file_path", F.lit("")).alias("path")), "node_id")
    folder = F.element_at(F.split("path", "/"), 1)
    top = named.groupBy("community_id", "repo_id", folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    top = top.groupBy("community_id", "repo_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "folder")).alias("t"))
    first = named.groupBy("community_id").agg(F.min_by("name", "stable_id").alias("first"))
    communities = top.join(first, "community_id").select("community_id", "repo_id", F.concat_ws(" · ", F.col("t.folder"), "first").alias("label"))
    empty = {c: F.lit(None).cast("string") for c in ("subtree_hash", "summary", "summary_hash")}
    return communities.withColumns(empty), members


def summarize(store: GraphStore, embedder: Embedder) -> dict[str, int]:
    """Summaries and their vectors for communities whose content changed: skipped, reused from the cache, or made."""
    nodes, chunks = store.read("nodes"), store.read("chunks")
    communities, members, cache = store.read("communities"), store.read("members"), store.read("summary_cache")
    hashes = M.community_hashes(members, nodes, _file_hashes(store))
    vectors = store.read("embeddings").filter(F.col("model_id") == f"{SUMMARIES}:{embedder.model_id}").select(F.col("chunk_id").alias("community_id"))
    states = cut(W.summary_counts(hashes, communities, cache, vectors))
    todo = states.filter("state <> 'skipped'").select("community_id", "hash")
    from .functions import layers as L

    roles = S.layer_vote(members.join(nodes.select("node_id", L.of_path(F.coalesce("file_path", F.lit("")), F.col("kind")).alias("layer")), "node_id"))
    fresh = S.composed(S.inputs(communities, members, nodes, chunks), roles).join(todo, "community_id")
    made = cut(fresh.join(cache.withColumnRenamed("summary", "known"), "hash", "left").select("community_id", "hash", F.coalesce("known", "summary").alias("summary")))
    texts = made.select(F.col("community_id").alias("chunk_id"), "hash", F.col("summary").alias("content"))
    v = embedded(texts, "chunk_id", "content", embedder).join(texts.select("chunk_id", F.col("hash").alias("content_hash")), "chunk_id")
    rows = v.select(F.concat(F.lit("summary:"), "chunk_id").alias("embedding_id"), "chunk_id", F.lit(embedder.provider).alias("provider"), F.lit(f"{SUMMARIES}:{embedder.model_id}").alias("model_id"), F.lit(embedder.dimensions).alias("dimensions"), "content_hash", "embedding")
    counts = {r.state: r.n for r in states.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts.get("pending", 0) + counts.get("reused", 0):
        old = store.read("embeddings").join(todo.select(F.col("community_id").alias("chunk_id")), "chunk_id", "left_anti")
        new_c, new_cache = W.save_summaries(W.with_hashes(communities, hashes, "community_id", "subtree_hash"), cache, made)
        store.write({"communities": new_c, "summary_cache": new_cache, "embeddings": W.insert_embeddings(old, rows)}, "summaries")
    return {k: counts.get(k, 0) for k in ("skipped", "reused", "pending")}


def _build(store: GraphStore, embedder: Embedder, repositories: DataFrame) -> dict[str, int]:
    """After the graph changed: vectors, communities, hashes, summaries."""
    n = store.embed_missing(embedder)
    communities, members = _community_rows(store)
    here = repositories.select("repo_id").distinct()
    kept = store.read("members").join(here, "repo_id", "left_anti").unionByName(members.join(here, "repo_id", "left_semi"))
    detected = communities.join(here, "repo_id", "left_semi")
    store.write({"communities": cut(W.replace_communities(store.read("communities"), detected, here)), "members": cut(kept)}, "communities")
    return {"embedded": n, **summarize(store, embedder)}


def analyze(store: GraphStore, files: DataFrame, repositories: DataFrame, embedder: Embedder) -> dict[str, int]:
    """Index whole repositories.  files: (repo_id, file_id, path, content, content_hash); repositories: as stored.
    The run is logged as completed or failed; vectors of unchanged content are kept, so nothing is embedded twice."""
    first = repositories.select("repo_id", "current_commit_sha").first()
    run = store.open_run(first.repo_id, first.current_commit_sha)
    try:
        batch = X.graph(X.indexed(files), repositories)
        batch["files"] = files.select("file_id", "repo_id", "path", "content_hash")
        graph = W.replace_index(store.graph(), {**batch}, repositories)
        graph["repositories"] = W.upsert_repositories(store.read("repositories"), repositories)
        store.write({n: cut(df) for n, df in graph.items()}, "index")
        out = _build(store, embedder, repositories)
        store.close_run(run, "completed")
        return out
    except Exception as e:
        store.close_run(run, "failed", str(e)[:500])
        raise


def add(store: GraphStore, files: DataFrame, repositories: DataFrame, paths: DataFrame, embedder: Embedder) -> DataFrame:
    """Index the changed paths (repo_id, path) only; (community_id, size) of the communities whose content changed."""
    before = cut(M.community_hashes(store.read("members"), store.read("nodes"), _file_hashes(store)))
    here = files.join(paths.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
    batch = X.graph(X.indexed(here), repositories)
    batch["files"] = here.select("file_id", "repo_id", "path", "content_hash")
    store.write({n: cut(df) for n, df in W.merge_files(store.graph(), batch, paths).items()}, "merge")
    _build(store, embedder, repositories)
    after = M.community_hashes(store.read("members"), store.read("nodes"), _file_hashes(store))
    return cut(M.blast_radius(M.changed(before, after, "community_id"), store.read("members")))


def searchable(store: GraphStore, embedder: Embedder) -> dict[str, DataFrame]:
    e = store.read("embeddings")
    of = lambda model: e.filter((F.col("provider") == embedder.provider) & (F.col("model_id") == model))
    return {
        "chunks": store.read("chunks").withColumn("path", F.coalesce("file_path", F.lit(""))), "vectors": of(embedder.model_id).select("chunk_id", "embedding"),
        "edges": store.read("edges"), "members": store.read("members"), "communities": store.read("communities"),
        "community_vectors": of(f"{SUMMARIES}:{embedder.model_id}").select(F.col("chunk_id").alias("community_id"), "embedding"),
    }


def query(store: GraphStore, question: str, embedder: Embedder, limit: int = 12, hierarchical: bool = False) -> DataFrame:
    g, v = searchable(store, embedder), embedder.embed_batch([question])[0]
    return Q.hierarchical(g, question, v, limit)[1] if hierarchical else Q.flat(g, question, v, limit)


def paths(store: GraphStore, hits: DataFrame) -> DataFrame:
    return Q.context_paths(store.read("edges"), hits)


def feature_context(store: GraphStore, task: str, embedder: Embedder, limit: int = 12) -> DataFrame:
    return Q.feature(searchable(store, embedder), task, embedder, limit)


def impact(store: GraphStore, task: str, embedder: Embedder, limit: int = 24) -> DataFrame:
    hits = feature_context(store, task, embedder, limit).join(store.read("chunks").select("chunk_id", "chunk_type"), "chunk_id")
    return P.impact(hits.withColumn("question", F.lit(task)))


def stack(store: GraphStore) -> DataFrame:
    return T.report(store.read("nodes"), store.read("chunks"))


def stats(store: GraphStore) -> DataFrame:
    out = None
    for n in ("files", "nodes", "edges", "chunks", "members"):
        one = store.read(n).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).withColumn("relation", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


def link_project(store: GraphStore, project_id: str, matches: DataFrame) -> bool:
    """Make a project's links anew from matches, unless every member is linked at the root hash it has now."""
    roots = M.root_hashes(_file_hashes(store))
    members = store.read("project_members")
    now = members.filter(F.col("project_id") == project_id).join(roots, "repo_id", "left")
    if not now.filter(~F.col("hash").eqNullSafe(F.col("linked_hash"))).limit(1).count():
        return False
    links = K.aggregated(matches, dominant_community(store.read("nodes"), store.read("members")))
    store.write({"links": cut(W.replace_links(store.read("links"), project_id, links)), "project_members": cut(W.set_linked(members, roots, project_id))}, "links")
    return True


def link_projects_of(store: GraphStore, repositories: DataFrame, matches: DataFrame) -> dict[str, str]:
    """All projects of the repositories; a failure is reported and stops no other."""
    out = {}
    for r in W.projects_of(store.read("project_members"), store.read("projects"), repositories).select("project_id").distinct().collect():  # a person makes projects
        try:
            out[r.project_id] = "linked" if link_project(store, r.project_id, matches) else "up to date"
        except Exception as e:  # noqa: BLE001
            out[r.project_id] = f"failed: {e}"[:200]
    return out
