"""Keyword, literal and symbol search; merging, ranking and routing of hits."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V


def literal(chunks: DataFrame, term: str, k: int | None = None) -> DataFrame:
    """1.5 if the path has the term, 0.35 if the content has it."""
    t = term.lower()
    path, content = F.lower("path").contains(t), F.lower("content").contains(t)
    score = F.when(path, 1.5).otherwise(0.0) + F.when(content, 0.35).otherwise(0.0)
    rows = chunks.filter(path | content).select("chunk_id", "path", "line_start", score.alias("score"))
    return rows.orderBy(F.desc("score"), F.asc_nulls_last("line_start"), "chunk_id").limit(k) if k else rows


def symbols(nodes: DataFrame, term: str, k: int | None = None) -> DataFrame:
    """Names like the term, in which % and _ are wildcards; exact names first."""
    exact = F.lower("name") == term.lower()
    rows = nodes.filter(~F.col("kind").isin("repository", "file") & F.col("name").ilike(f"%{term}%")).select("node_id", "name", "kind", "line_start", exact.alias("exact"))
    return rows.orderBy(F.desc("exact"), "kind", F.asc_nulls_last("line_start"), "node_id").limit(k) if k else rows


def keyword(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks that hold all words; the score is the cover density: for every place of the rarest word in the text
    that lies within eight words of all others, one over the span.  No stemming."""
    terms = sorted({t for t in "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in query).split() if len(t) > 1})
    tokens = T.search_tokens(F.col("content"), 0)
    base = chunks.select("chunk_id", tokens.alias("w"))
    for t in terms:
        base = base.filter(F.array_contains("w", t))
    first = terms[0]
    at = F.filter(F.transform(F.col("w"), lambda x, i: F.when(x == first, i)), lambda i: i.isNotNull())
    window = lambda i: F.slice("w", F.greatest(F.lit(1), i - 7), F.lit(16))
    covers = F.filter(at, lambda i: reduce(lambda a, b: a & b, [F.array_contains(window(i), t) for t in terms]))
    return base.select("chunk_id", F.size(at).alias("places"), F.round(F.size(covers) / F.lit(8.0), 6).alias("score"))


def literal_score(path: Column, content: Column, term: str) -> Column:
    """1.5 if the path has the term and 0.35 if the content has it; null if neither has."""
    t = term.lower()
    in_path, in_content = F.lower(path).contains(t), F.lower(content).contains(t)
    return F.when(in_path | in_content, F.when(in_path, 1.5).otherwise(0.0) + F.when(in_content, 0.35).otherwise(0.0))


def keyword_score(content: Column, query: str) -> Column:
    """The score of ``keyword`` where the content holds all words, else null.  The text is looked through as it is before
    it is cut into words."""
    terms = sorted({t for t in "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in query).split() if len(t) > 1})
    if not terms:
        return F.lit(None).cast("double")
    every = lambda x, has: reduce(lambda a, b: a & b, [has(x, t) for t in terms])

    def score(w: Column) -> Column:
        at = F.filter(F.transform(w, lambda x, i: F.when(x == terms[0], i)), lambda i: i.isNotNull())
        near = lambda i: F.slice(w, F.greatest(F.lit(1), i - 7), F.lit(16))
        covers = F.filter(at, lambda i: every(near(i), F.array_contains))
        return F.when(every(w, F.array_contains), F.round(F.size(covers) / F.lit(8.0), 6))

    # the words are bound once
    scored = F.transform(F.array(T.search_tokens(content, 0)), score)
    return F.when(every(T.ascii_lower(content), lambda x, t: x.contains(t)), F.element_at(scored, 1))


def hits(chunks: DataFrame, asked: list[tuple[str, str, list[str], int]]) -> DataFrame:
    """(question, chunk_id, score, method_no, method) of the keyword search (1) and the literal terms (2, ...) of all
    questions in one pass over the chunks (chunk_id, path, content, line_start).  asked: (question, keywords, terms, most
    keyword hits); of every term the twelve best, and no limit where that is 0."""
    columns = [F.struct(F.lit(q).alias("question"), F.lit(1).alias("method_no"), F.lit("keyword").alias("method"), F.lit(most).alias("most"), keyword_score(F.col("content"), k).alias("score")) for q, k, _, most in asked]
    for q, _, terms, most in asked:
        columns += [F.struct(F.lit(q).alias("question"), F.lit(2 + i).alias("method_no"), F.lit("literal").alias("method"), F.lit(min(12, most) if most else 0).alias("most"), literal_score(F.col("path"), F.col("content"), t).alias("score")) for i, t in enumerate(terms)]
    rows = chunks.select("chunk_id", "line_start", F.explode(F.filter(F.array(*columns), lambda x: x["score"].isNotNull())).alias("h")).select("chunk_id", "line_start", "h.*")
    if any(most for *_, most in asked):
        order = [F.desc("score"), F.when(F.col("method_no") > 1, F.coalesce("line_start", F.lit(2**31 - 1))), "chunk_id"]
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("question", "method_no").orderBy(*order)))
        if all(most for *_, most in asked):  # a constant bound is applied before the shuffle
            rows = rows.filter(F.col("r") <= max(12, *(most for *_, most in asked), 0))
        rows = rows.filter("most = 0 or r <= most").drop("r")
    return rows.select("question", "chunk_id", F.col("score").cast("double").alias("score"), "method_no", "method")


def merged(hits: DataFrame, order: str = "method_no", base: int = 0) -> DataFrame:
    """(question, chunk_id, score, retrieved_by): the first method's score (three quarters of it unless it is the
    base) and a quarter of each later one."""
    lists = hits.groupBy("question", "chunk_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "score", "method"))).alias("h"))
    first = F.element_at("h", 1)
    start = F.when(first["o"] == base, first["score"]).otherwise(first["score"] * 0.75)
    rest = F.aggregate(F.slice("h", F.lit(2), F.greatest(F.size("h") - 1, F.lit(0))), F.lit(0.0), lambda s, x: s + F.greatest(x["score"], F.lit(0.0)) * 0.25)
    return lists.select("question", "chunk_id", F.round(start + rest, 6).alias("score"), F.array_join(F.array_distinct(F.transform("h", lambda x: x["method"])), ",").alias("retrieved_by"))


def merged_duplicates(hits: DataFrame) -> DataFrame:
    """Across expansions, in their order: the greater score and 0.12 of the new one."""
    lists = hits.groupBy("question", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("expansion", "score"))).alias("h"))
    start = F.element_at("h", 1)["score"]
    fold = F.aggregate(F.slice("h", F.lit(2), F.greatest(F.size("h") - 1, F.lit(0))), start, lambda s, x: F.greatest(s, x["score"]) + F.greatest(x["score"], F.lit(0.0)) * 0.12)
    return lists.select("question", "chunk_id", F.round(fold, 6).alias("score"))


def reranked(hits: DataFrame, query: Column) -> DataFrame:
    """Multiplicative factors, in a fixed order; needs content, path, metadata and score."""
    q = T.ascii_lower(query)
    tokens = T.search_tokens(q)
    content, path, meta = T.ascii_lower(F.col("content")), T.ascii_lower(F.col("path")), T.ascii_lower(F.coalesce("metadata", F.lit("{}")))
    lexical = T.lexical_count(tokens, content, path, meta)
    key = lambda k: F.get_json_object("metadata", f"$.{k}")
    kind = F.coalesce(key("kind"), key("ecosystem"), F.col("content"))
    dependency, deployment = T.contains_any(q, V.DEPENDENCY_WORDS), T.contains_any(q, V.DEPLOYMENT_WORDS)
    # The factors and the words of deployment content.
    infra = T.contains_any(content, ["deploy", "stack", "infrastructure", "cdk", "terraform", "kubernetes"])
    factors = [
        F.when(lexical > 0, 1 + F.least(lexical * 0.08, F.lit(0.8))),
        F.when(F.exists(tokens, lambda t: (F.length(t) > 3) & path.contains(t)), 1.5),
        F.when(key("dependency").isNotNull() & ~dependency, 0.25),
        F.when(key("source_priority") == "supplemental", 0.72),
        F.when(key("script").isNotNull(), 1.25),
        F.when(key("technology") == "aws_cdk", 1.35),
        F.when(deployment & infra, 1.6),
        F.when(kind.isin("function", "struct", "trait"), 1.04),
    ]
    product = reduce(lambda a, f: a * F.coalesce(f, F.lit(1.0)), factors, F.col("score"))
    return hits.withColumn("score", F.round(product, 6))


def suppressed_dependencies(hits: DataFrame, dependency_query: bool) -> DataFrame:
    """Per question, dependency hits go if any other kind of hit is there and the question is not about them."""
    if dependency_query:
        return hits
    has = F.get_json_object("metadata", "$.dependency").isNotNull()
    other = F.max((~has).cast("int")).over(Window.partitionBy("question"))
    return hits.withColumn("other", other).filter(~has | (F.col("other") == 0)).drop("other")


def retained_documents(ranked: DataFrame, limit: int) -> DataFrame:
    """Keeps room for supplemental hits in the first ``limit`` of a question's at most 200 candidates: the best later
    ones move just before the cut, one at a time, and what a move pushes out may be taken again."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        rows = b.sort_values(["score", "chunk_id"], ascending=[False, True]).to_dict("records")
        if len(rows) > limit:
            need = max(1, min(3, limit // 5))
            need = max(0, need - sum(r["supplemental"] for r in rows[:limit]))
            at = limit
            while need and at < len(rows):
                if rows[at]["supplemental"]:
                    rows.insert(limit - 1, rows.pop(at))
                    need -= 1
                else:
                    at += 1
        out = pd.DataFrame(rows[:limit])
        out["place"] = range(1, len(out) + 1)
        return out[["question", "chunk_id", "place"]]

    bounded = ranked.withColumn("r", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "chunk_id"))).filter("r <= 200").drop("r")
    return bounded.groupBy("question").applyInPandas(run, "question string, chunk_id string, place int")


def expansions(task: Column) -> Column:
    """The task, three fixed widenings, and the task with separators as spaces where that differs."""
    # The endings.
    fixed = [F.concat(task, F.lit(x)) for x in (" documentation docs README guide architecture", " source implementation contracts services hooks tests", " workflow user story infrastructure deployment configuration")]
    plain = F.trim(F.regexp_replace(F.translate(task, "-_", "  "), r"\s+", " "))
    extra = F.when(plain != task, F.array(plain)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(task, *fixed), extra)


def hierarchical_boost(hits: DataFrame, membership: DataFrame, routed: DataFrame) -> DataFrame:
    """Hits whose node lies in a routed community count half as much again."""
    inside = membership.join(routed.select("question", "community_id"), "community_id").select("question", "node_id").distinct().withColumn("inside", F.lit(True))
    return hits.join(inside, ["question", "node_id"], "left").select("question", "chunk_id", F.round(F.col("score") * F.when(F.col("inside"), 1.5).otherwise(1.0), 6).alias("score"))
