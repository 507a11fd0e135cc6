"""Retrieval from question to answer: candidates of three methods, merge, rank, documents kept, context paths.

Every function takes a question and what an embedder made of it; the answer is one lazy plan per question.  A graph is a
dict: chunks (chunk_id, repo_id, node_id, path, chunk_type, content, metadata, line_start), vectors (chunk_id,
embedding) of one model, edges, members (community_id, node_id), communities (community_id, label), community_vectors
(community_id, embedding).

Defined results: a question without words finds by meaning only, one without a vector by words only; equal scores are in
the order of chunk_id; null contents are found by nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph as G
from . import search as S
from . import vector as X

# Routing floor, score and number of routes by label, sizes of what is returned.
ROUTE_FLOOR, LABEL_SCORE, LABEL_ROUTES, ROUTES = 0.30, 0.5, 5, 8
CHUNK_CHARS, SUMMARY_CHARS = 800, 400
LITERAL_TERMS = 10


def _words(spark, column) -> list[str]:
    """The value of an array expression over constants."""
    return spark.range(1).select(column).first()[0] or []


def candidates(graph: dict[str, DataFrame], questions: list[tuple[str, list[float] | None]], limit: int) -> DataFrame:
    """(question, expansion, chunk_id, score, method_no, method) by meaning, by words and by literal terms; the chunks are
    passed over once for all questions."""
    chunks = graph["chunks"].filter("content is not null")
    spark = chunks.sparkSession
    terms = [_words(spark, T.literal_terms(F.lit(q)))[:LITERAL_TERMS] for q, _ in questions]
    rows = S.hits(chunks, [(str(i), q, t, limit) for i, ((q, _), t) in enumerate(zip(questions, terms))])
    for i, (_, vector) in enumerate(questions):
        if vector is not None:
            near = X.top_k(graph["vectors"], "chunk_id", vector, limit)
            rows = rows.unionByName(near.select(F.lit(str(i)).alias("question"), "chunk_id", F.col("score").cast("double").alias("score"), F.lit(0).alias("method_no"), F.lit("semantic").alias("method")))
    return rows.withColumn("expansion", F.col("question").cast("int"))


def answer(graph: dict[str, DataFrame], task: str, questions: list[tuple[str, list[float] | None]], limit: int = 12) -> DataFrame:
    """(place, chunk_id, node_id, path, score, retrieved_by, content) of the first ``limit`` hits."""
    many = max(40, min(200, 8 * limit))
    chunks = graph["chunks"]
    every = S.merged(candidates(graph, questions, many)).withColumn("expansion", F.col("question").cast("int")).withColumn("question", F.lit(task))
    methods = every.groupBy("chunk_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("retrieved_by", ","))))), ",").alias("retrieved_by"))
    hits = S.merged_duplicates(every.select("question", "chunk_id", "expansion", "score")).join(chunks, "chunk_id")
    ranked = S.reranked(hits, F.lit(task))
    lower = task.lower()
    from ..functions import vocabulary as V

    kept = S.suppressed_dependencies(ranked, any(w in lower for w in V.DEPENDENCY_WORDS))
    kept = kept.withColumn("supplemental", F.coalesce(F.get_json_object("metadata", "$.source_priority") == "supplemental", F.lit(False)))
    placed = S.retained_documents(kept.select("question", "chunk_id", "score", "supplemental"), limit)
    return placed.join(kept, ["question", "chunk_id"]).join(methods, "chunk_id").select("place", "chunk_id", "node_id", "path", "score", "retrieved_by", "content").orderBy("place")


def flat(graph: dict[str, DataFrame], question: str, vector: list[float] | None, limit: int = 12) -> DataFrame:
    return answer(graph, question, [(question, vector)], limit)


def feature(graph: dict[str, DataFrame], task: str, embedder, limit: int = 12) -> DataFrame:
    """Over the task's expansions, each embedded by itself."""
    asked = _words(graph["chunks"].sparkSession, S.expansions(F.lit(task)))
    vectors = embedder.embed_batch(asked) if embedder else [None] * len(asked)
    return answer(graph, task, list(zip(asked, vectors)), limit)


def routes(graph: dict[str, DataFrame], question: str, vector: list[float] | None) -> DataFrame:
    """(community_id, label, member_count, score, how): by meaning of their summaries, and only if none is near enough by
    their labels, the largest first."""
    sizes = graph["members"].groupBy("community_id").agg(F.count(F.lit(1)).alias("member_count")).filter("member_count >= 2")
    named = graph["communities"].select("community_id", "label").join(sizes, "community_id")
    near = None
    if vector is not None:
        near = X.top_k(graph["community_vectors"], "community_id", vector, ROUTES).filter(F.col("score") >= ROUTE_FLOOR).join(named, "community_id").withColumn("how", F.lit("summary"))
        near = near.select("community_id", "label", "member_count", "score", "how")
    by_label = named.filter(T.label_matches(F.col("label"), T.router_tokens(F.lit(question)))).orderBy(F.desc("member_count"), "community_id").limit(LABEL_ROUTES)
    by_label = by_label.select("community_id", "label", "member_count", F.lit(LABEL_SCORE).alias("score"), F.lit("label").alias("how"))
    if near is None:
        return by_label
    none = near.agg((F.count(F.lit(1)) == 0).alias("none"))
    return near.unionByName(by_label.join(F.broadcast(none), F.col("none")).drop("none"))  # one row


def hierarchical(graph: dict[str, DataFrame], question: str, vector: list[float] | None, limit: int = 12) -> tuple[DataFrame, DataFrame]:
    """(routes, hits): hits of the flat search, half as much again where their node is in a routed community; ``mode``
    says whether there was any."""
    way = routes(graph, question, vector)
    hits = flat(graph, question, vector, limit)
    inside = graph["members"].join(way.select("community_id"), "community_id", "left_semi").select("node_id").distinct().withColumn("inside", F.lit(True))
    any_ = way.agg(F.when(F.count(F.lit(1)) > 0, "hierarchical").otherwise("flat-fallback").alias("mode"))
    out = hits.join(inside, "node_id", "left").withColumn("score", F.round(F.col("score") * F.when(F.col("inside"), 1.5).otherwise(1.0), 6)).drop("inside").join(F.broadcast(any_))
    cut = T.truncated(F.col("content"), CHUNK_CHARS)
    return way.orderBy(F.desc("score"), F.desc("member_count"), "community_id"), out.withColumn("content", cut).orderBy(F.desc("score"), "place")


def context_paths(edges: DataFrame, hits: DataFrame, most: int = 8) -> DataFrame:
    """(start, end, total_cost, nodes): the cheapest ways between hit nodes over the edges that touch them, each pair once
    in the order of the hits."""
    seeds = hits.filter("node_id is not null").groupBy("node_id").agg(F.min("place").alias("place"))
    out = edges.join(seeds.select(F.col("node_id").alias("source")), "source", "left_semi").unionByName(edges.join(seeds.select(F.col("node_id").alias("target")), "target", "left_semi"))
    ways = G.cheapest_paths(out.select("source", "target", "cost").distinct(), seeds, hops=None, nodes=True)
    at = lambda c: seeds.select(F.col("node_id").alias(c), F.col("place").alias(f"{c}_place"))
    pairs = ways.join(at("start"), "start").join(at("end"), "end").filter("start_place < end_place")
    return pairs.orderBy("cost", "start_place", "end_place").limit(most).select("start", "end", F.col("cost").alias("total_cost"), "nodes")
