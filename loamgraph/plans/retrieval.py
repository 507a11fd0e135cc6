from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layers as L
from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import search as S
from ..operators import vector as X
from ..session import table
from ..sources import relations as R
from .catalog import _W

_Q = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
_QSQL = "[" + ", ".join(f"{x}::DOUBLE" for x in _Q) + "]"
_QUESTION = "How does the ledger cursor configuration package work with deploy_stack?"
_COS = "round(list_cosine_similarity(embedding::DOUBLE[], {q}), 6)"


def _mini(s, d):
    return R.embeddings(s, d).filter("model_id = 'quillmini-64'")


def _placed(s, d):
    return R.chunks(s, d).join(R.files(s, d).select("file_id", "path"), "file_id", "left").withColumn("path", F.coalesce("path", F.lit("")))


def _hits(s, d):
    """Three methods' hits of two questions; the chunks are read once for both."""
    words = S.hits(_placed(s, d), [("q1", "ledger limit", ["ledger"], 0), ("q2", "cursor limit", ["cursor"], 0)])
    near = X.top_k(_mini(s, d), "chunk_id", _Q, 40).select(F.explode(T.words("q1", "q2")).alias("question"), "chunk_id", F.col("score").cast("double").alias("score"), F.lit(0).alias("method_no"), F.lit("semantic").alias("method"))
    return words.unionByName(near)


def _rank_input(s, d):
    return S.literal(_placed(s, d), "cursor").select("chunk_id", "score").join(_placed(s, d).drop("path"), "chunk_id").join(R.files(s, d).select("file_id", "path"), "file_id", "left").withColumn("path", F.coalesce("path", F.lit("")))


def _rerank(s, d):
    return S.reranked(_rank_input(s, d), F.lit(_QUESTION)).select("chunk_id", "score")


def _pipeline(s, d):
    """Candidates, merge, rank, keep documents, first twelve."""
    merged = S.merged(_hits(s, d)).select("question", "chunk_id", "score").join(_placed(s, d), "chunk_id")
    ranked = S.reranked(merged, F.lit(_QUESTION))
    kept = S.suppressed_dependencies(ranked, False).withColumn("supplemental", F.col("chunk_type").isin("config", "module"))
    return S.retained_documents(kept.select("question", "chunk_id", "score", "supplemental"), 12)


_RERANK_TOK = [t for t in "".join(c if c.isalnum() else " " for c in _QUESTION.lower()).split() if len(t) > 1]
_HITS_SQL = f"""
 placed AS (SELECT c.*, coalesce(f.path, '') AS path FROM chks c LEFT JOIN files f USING (file_id)),
 lit AS (SELECT q, chunk_id, (CASE WHEN contains(lower(path), t) THEN 1.5 ELSE 0 END + CASE WHEN contains(lower(content), t) THEN 0.35 ELSE 0 END)::DOUBLE AS score
         FROM placed, (VALUES ('q1', 'ledger'), ('q2', 'cursor')) v(q, t) WHERE contains(lower(path), t) OR contains(lower(content), t)),
 tok AS (SELECT chunk_id, [x FOR x IN regexp_split_to_array(lower(content), '[^a-z0-9]+') IF len(x) > 0] AS w FROM chks),
 kw0 AS (SELECT q, chunk_id, w, list_sort([t, 'limit'])[1] AS f, t, [i FOR i IN range(0, len(w)) IF w[i + 1] = list_sort([t, 'limit'])[1]] AS spots FROM tok, (VALUES ('q1', 'ledger'), ('q2', 'cursor')) v(q, t)
         WHERE list_contains(w, t) AND list_contains(w, 'limit')),
 kw AS (SELECT q, chunk_id, len(spots) AS places, round(len([i FOR i IN spots IF list_contains(w[greatest(1, i - 7):greatest(1, i - 7) + 15], t) AND list_contains(w[greatest(1, i - 7):greatest(1, i - 7) + 15], 'limit')]) / 8.0, 6)::DOUBLE AS score FROM kw0),
 sem AS (SELECT chunk_id, {_COS.format(q=_QSQL)} AS score FROM vecs WHERE model_id = 'quillmini-64' ORDER BY score DESC, chunk_id LIMIT 40),
 hits AS (SELECT 'q1' AS question, chunk_id, score, 0 AS method_no, 'semantic' AS method FROM sem UNION ALL SELECT 'q2', chunk_id, score, 0, 'semantic' FROM sem
          UNION ALL SELECT q, chunk_id, score, 1, 'keyword' FROM kw UNION ALL SELECT q, chunk_id, score, 2, 'literal' FROM lit)
"""
_factor = f"""CASE WHEN lex > 0 THEN 1 + least(lex * 0.08, 0.8) ELSE 1 END
  * CASE WHEN list_bool_or([len(t) > 3 AND contains(lower(path), t) FOR t IN {_RERANK_TOK}]) THEN 1.5 ELSE 1 END
  * CASE WHEN lower(content) LIKE '%deploy%' OR lower(content) LIKE '%stack%' OR lower(content) LIKE '%infrastructure%' OR lower(content) LIKE '%cdk%' OR lower(content) LIKE '%terraform%' OR lower(content) LIKE '%kubernetes%' THEN 1.6 ELSE 1 END
  * CASE WHEN content IN ('function', 'struct', 'trait') THEN 1.04 ELSE 1 END"""


def _asked(s, d):
    """The vectors of every hundredth chunk, by its id's last four digits."""
    return _mini(s, d).filter("conv(right(chunk_id, 4), 16, 10) % 100 = 0")


def _layer_scores(s, d):
    """Names of nodes against the words of each layer, as a stand-in for prototype vectors: share of equal letters."""
    e = _mini(s, d).join(R.chunks(s, d).select("chunk_id", "file_id"), "chunk_id").join(R.files(s, d).select("file_id", "path"), "file_id")
    v = F.col("embedding")
    q = F.array(*[F.lit(x) for x in _Q])
    score = F.round(0.6 + X.cosine(v, q, X.norm(v), F.lit(sum(x * x for x in _Q) ** 0.5)), 6)
    return e.select(F.substring("chunk_id", 1, 1).alias("query"), L.of_path(F.col("path"), F.lit("")).alias("layer"), score.alias("score"))


QUERIES = {
    "semantic_topk": lambda s, d: X.top_k(_mini(s, d), "chunk_id", _Q, 20),
    "community_topk": lambda s, d: X.top_k(X.centroid(_mini(s, d).join(R.chunks(s, d).select("chunk_id", "repo_id"), "chunk_id"), "repo_id"), "repo_id", _Q, 8),
    "semantic_neighbors": lambda s, d: X.neighbours_of_seeds(_mini(s, d), _asked(s, d), "chunk_id", 0.3),
    "pairwise_similarity": lambda s, d: X.pairwise(_mini(s, d).join(R.chunks(s, d).select("chunk_id", "file_id"), "chunk_id"), "embedding_id", ["file_id"]),
    "layer_route_maxpool": lambda s, d: X.routed_layers(_layer_scores(s, d)),
    "invalid_vectors": lambda s, d: X.invalid(table(s, d, "chunk_embeddings")),
    "benchmark_vectors_topk": lambda s, d: X.top_k(table(s, d, "embeddings").filter(F.size("embedding") == 64), "vec_id", _Q, 10),
    "literal_search": lambda s, d: S.literal(_placed(s, d), "ledger"),
    "symbol_search": lambda s, d: S.symbols(R.nodes(s, d), "link_"),
    "keyword_search": lambda s, d: S.keyword(R.chunks(s, d), "ledger limit"),
    "hybrid_merge": lambda s, d: S.merged(_hits(s, d)),
    "merge_duplicates": lambda s, d: S.merged_duplicates(_hits(s, d).withColumn("expansion", F.col("method_no"))),
    "rerank_factors": _rerank,
    "suppress_dependencies": lambda s, d: S.suppressed_dependencies(
        R.chunks(s, d).select(F.col("repo_id").alias("question"), "chunk_id", F.when(F.col("chunk_type") == "config", F.lit('{"dependency": "x"}')).otherwise(F.col("metadata")).alias("metadata")), False
    ).select("question", "chunk_id"),
    "retain_supplemental": _pipeline,
    "query_expansions": lambda s, d: R.nodes(s, d).filter("kind in ('struct', 'trait')").select("node_id", F.posexplode(S.expansions(F.col("name")))).select("node_id", F.col("pos").alias("no"), F.col("col").alias("query")),
    "hierarchical_boost": lambda s, d: S.hierarchical_boost(
        _hits(s, d).filter("method = 'literal'").join(R.chunks(s, d).select("chunk_id", "node_id"), "chunk_id"),
        R.members(s, d), R.communities(s, d).filter(T.label_matches(F.col("label"), T.words("packages", "report"))).select(F.lit("q1").alias("question"), "community_id"),
    ),
    "score_text": lambda s, d: R.chunks(s, d).select("chunk_id", T.score_text(T.words("cursor", "ledger", "lane"), F.col("content")).alias("score")),
}
SQL = {
    "semantic_topk": _W + f"SELECT chunk_id, {_COS.format(q=_QSQL)} AS score FROM vecs WHERE model_id = 'quillmini-64' ORDER BY score DESC, chunk_id LIMIT 20",
    "community_topk": _W + f", p AS (SELECT c.repo_id, unnest(v.embedding) AS x, generate_subscripts(v.embedding, 1) AS i FROM vecs v JOIN chks c USING (chunk_id) WHERE model_id = 'quillmini-64'), m AS (SELECT repo_id, i, avg(x::DOUBLE) AS m FROM p GROUP BY ALL), e AS (SELECT repo_id, list(m ORDER BY i) AS embedding FROM m GROUP BY repo_id) SELECT repo_id, {_COS.format(q=_QSQL)} AS score FROM e ORDER BY score DESC, repo_id LIMIT 8",
    "semantic_neighbors": _W + ", seeds AS (SELECT chunk_id AS sid, embedding AS se FROM vecs WHERE model_id = 'quillmini-64' AND ('0x' || right(chunk_id, 4))::INT % 100 = 0) SELECT chunk_id, max(round(list_cosine_similarity(embedding::DOUBLE[], se::DOUBLE[]), 6)) AS best FROM vecs, seeds WHERE model_id = 'quillmini-64' AND chunk_id NOT IN (SELECT sid FROM seeds) GROUP BY chunk_id HAVING best >= 0.3",
    "pairwise_similarity": _W + ", v AS (SELECT v.*, c.file_id FROM vecs v JOIN chks c USING (chunk_id) WHERE model_id = 'quillmini-64') SELECT a.embedding_id AS a, b.embedding_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM v a JOIN v b USING (file_id) WHERE a.embedding_id < b.embedding_id",
    "invalid_vectors": "SELECT DISTINCT embedding_id, CASE WHEN embedding IS NULL THEN 'null' WHEN len(embedding) <> dimensions THEN 'size' WHEN list_bool_or([isnan(x) OR isinf(x) FOR x IN embedding]) THEN 'not finite' WHEN list_bool_and([x = 0 FOR x IN embedding]) THEN 'zero' END AS reason FROM chunk_embeddings WHERE reason IS NOT NULL",
    "benchmark_vectors_topk": f"SELECT vec_id, {_COS.format(q=_QSQL)} AS score FROM embeddings WHERE len(embedding) = 64 ORDER BY score DESC, vec_id LIMIT 10",
    "literal_search": _W + ", " + _HITS_SQL + "SELECT l.chunk_id, p.path, p.line_start, l.score FROM lit l JOIN placed p USING (chunk_id) WHERE q = 'q1'",
    "symbol_search": _W + "SELECT node_id, name, kind, line_start, lower(name) = 'link_' AS exact FROM nodes WHERE kind NOT IN ('repository', 'file') AND name ILIKE '%link_%'",
    "keyword_search": _W + ", " + _HITS_SQL + "SELECT chunk_id, CAST(places AS INT) AS places, score FROM kw WHERE q = 'q1'",
    "hybrid_merge": _W + ", " + _HITS_SQL + ", l AS (SELECT question, chunk_id, list({o: method_no, s: score, m: method} ORDER BY method_no) AS h FROM hits GROUP BY ALL) SELECT question, chunk_id, round(CASE WHEN h[1].o = 0 THEN h[1].s ELSE h[1].s * 0.75 END + list_sum([0.0] || [greatest(x.s, 0) * 0.25 FOR x IN h[2:]]), 6) AS score, array_to_string([x.m FOR x IN h], ',') AS retrieved_by FROM l",
    "merge_duplicates": _W + ", " + _HITS_SQL + ", l AS (SELECT question, chunk_id, list(score ORDER BY method_no) AS h FROM hits GROUP BY ALL) SELECT question, chunk_id, round(list_reduce(h, lambda a, x: greatest(a, x) + greatest(x, 0) * 0.12), 6) AS score FROM l",
    "rerank_factors": _W + ", " + _HITS_SQL + f", r AS (SELECT l.chunk_id, l.score, p.content, p.path, p.metadata, list_sum([(contains(lower(content), t))::INT + (contains(lower(path), t))::INT + (contains(lower(coalesce(metadata, '{{}}')), t))::INT FOR t IN {_RERANK_TOK}]) AS lex FROM lit l JOIN placed p USING (chunk_id) WHERE q = 'q2') SELECT chunk_id, round(score * {_factor}, 6) AS score FROM r",
    "suppress_dependencies": _W + "SELECT repo_id AS question, chunk_id FROM (SELECT *, max((chunk_type <> 'config')::INT) OVER (PARTITION BY repo_id) AS other FROM chks) WHERE chunk_type <> 'config' OR other = 0",
    "query_expansions": _W + """, n AS (SELECT node_id, name, trim(regexp_replace(translate(name, '-_', '  '), '\\s+', ' ', 'g')) AS p FROM nodes WHERE kind IN ('struct', 'trait')), x AS (SELECT node_id, [name, name || ' documentation docs README guide architecture', name || ' source implementation contracts services hooks tests', name || ' workflow user story infrastructure deployment configuration'] || CASE WHEN p <> name THEN [p] ELSE [] END AS l FROM n)
       SELECT node_id, CAST(i - 1 AS INT) AS no, l[i] AS query FROM x, (SELECT unnest(range(1, 6)) AS i) WHERE i <= len(l)""".replace("\\\\", "\\"),
    "hierarchical_boost": _W + ", " + _HITS_SQL + ", routed AS (SELECT community_id FROM comms WHERE list_has_any(regexp_split_to_array(lower(label), '[^a-z0-9]+'), ['packages', 'report']) OR list_bool_or([starts_with(x, 'packages') OR starts_with(x, 'report') FOR x IN regexp_split_to_array(lower(label), '[^a-z0-9]+')])), inside AS (SELECT DISTINCT node_id FROM mems WHERE community_id IN (SELECT community_id FROM routed)) SELECT l.q AS question, l.chunk_id, round(l.score * CASE WHEN l.q = 'q1' AND c.node_id IN (SELECT node_id FROM inside) THEN 1.5 ELSE 1 END, 6) AS score FROM lit l JOIN chks c USING (chunk_id)",
    "score_text": _W + "SELECT chunk_id, CAST(list_sum([(len(lower(content)) - len(replace(lower(content), t, ''))) // len(t) FOR t IN ['cursor', 'ledger', 'lane']]) AS INT) AS score FROM chks",
}
