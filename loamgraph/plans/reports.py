from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layers as L
from ..operators import catalog as C
from ..operators import links as K
from ..operators import merkle as M
from ..operators import reports as P
from ..operators import search as Q
from ..operators import stack as K2
from ..operators import summary as S
from ..operators import vector as X
from ..session import table
from ..sources import relations as R
from . import fixture as FX
from .catalog import _W, LAYER_SQL
from .graph import _CM, _MK, _comm_hash, _edited, _h


def _inputs(s, d):
    return S.inputs(R.communities(s, d), R.members(s, d), R.nodes(s, d), R.chunks(s, d))


def _roles(s, d):
    n = R.nodes(s, d).select("node_id", L.of_path(F.coalesce("file_path", F.lit("")), F.col("kind")).alias("layer"))
    return S.layer_vote(R.members(s, d).join(n, "node_id"))


def _gate(s, d):
    """Summaries were made before an edit of every struct."""
    old = _comm_hash(s, d).select("community_id", F.concat("hash", F.lit("-sum3")).alias("summary_hash"))
    return S.stale(_comm_hash(s, d, _edited(s, d)), old)


def _restore(s, d):
    cache = _comm_hash(s, d).select("hash", F.substring("community_id", 1, 8).alias("summary")).groupBy("hash").agg(F.min("summary").alias("summary"))
    return S.restored(_comm_hash(s, d).select("community_id", "hash"), cache)


def _symbol_links(s, d):
    n = R.nodes(s, d).filter("file_path is not null")
    definitions = n.filter("kind = 'struct'").select(F.lit("symbol").alias("kind"), "name", "repo_id", F.col("file_path").alias("path"))
    words = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b([A-Z][A-Za-z]{7,})\b"), F.lit(1)))).alias("name")
    uses = R.files(s, d).select(F.lit("symbol").alias("kind"), words, "repo_id", "path")
    return K.name_matches(definitions, uses.distinct())


def _pages(s, d):
    n = R.members(s, d).join(R.nodes(s, d).filter("file_path is not null").select("node_id", "file_path", "name", "kind"), "node_id")
    return n.select(F.col("community_id").alias("page"), F.lit("file").alias("kind"), F.col("file_path").alias("item")).unionByName(n.filter("kind <> 'file'").select(F.col("community_id").alias("page"), F.lit("symbol").alias("kind"), F.col("name").alias("item")))


def _hits(s, d):
    """Literal hits of two questions."""
    p = R.chunks(s, d).join(R.files(s, d).select("file_id", "path"), "file_id")
    out = None
    for term in ("ledger", "cursor"):
        one = Q.literal(p, term).select("chunk_id", "score", F.lit(term).alias("question"))
        out = one if out is None else out.unionByName(one)
    return out.join(p.select("chunk_id", "path", "chunk_type"), "chunk_id")


def _semantic(s, d):
    """Communities by the mean of their chunks' vectors against one question's."""
    v = R.embeddings(s, d).filter("model_id = 'quillmini-64'").join(R.chunks(s, d).select("chunk_id", "node_id"), "chunk_id").join(R.members(s, d), "node_id")
    return X.top_k(X.centroid(v, "community_id"), "community_id", QUESTION, 24)


QUESTION = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]


QUERIES = {
    "summary_inputs": lambda s, d: _inputs(s, d).select("community_id", "label", "member_count", F.size("members").alias("listed"), F.array_join(F.transform(F.slice("members", 1, 5), lambda m: m["name"]), ",").alias("first"), F.sha2(F.array_join("snippets", "\n"), 256).alias("snippets")),
    "compose_summary": lambda s, d: S.composed(_inputs(s, d), _roles(s, d)),
    "layer_vote": _roles,
    "summary_gate": _gate,
    "summary_cache_restore": _restore,
    "stack_dependencies": lambda s, d: P.packages(K2.dependencies(R.nodes(s, d))),
    "stack_scripts": lambda s, d: P.scripts(K2.scripts(FX.graph(s)["nodes"])),
    "stack_infra": lambda s, d: P.infrastructure(K2.deployments(FX.graph(s)["nodes"])),
    "impact_summary": lambda s, d: P.impact(_hits(s, d)),
    "manifest_correlate": lambda s, d: P.correlated(_pages(s, d)),
    "link_matches": _symbol_links,
    "link_aggregate": lambda s, d: K.aggregated(_symbol_links(s, d), C.dominant_community(R.nodes(s, d), R.members(s, d))),
    "feature_inventory": lambda s, d: P.features(R.communities(s, d), R.members(s, d), R.nodes(s, d), ["report", "ledger"]),
    "change_plan": lambda s, d: P.change_plan(_semantic(s, d).filter("score >= 0.05"), M.changed(_comm_hash(s, d), _comm_hash(s, d, _edited(s, d)), "community_id")),
    "context_warnings": lambda s, d: P.context_warnings(R.files(s, d).select(F.col("path").alias("word")).distinct(), R.files(s, d), R.files(s, d).filter("language = 'python'")),
}

_DM = "(SELECT repo_id, file_path, community_id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY c DESC, community_id) AS r FROM (SELECT m.repo_id, n.file_path, m.community_id, count(*) AS c FROM mems m JOIN nodes n USING (node_id) WHERE n.file_path IS NOT NULL AND community_id IN (SELECT community_id FROM mems GROUP BY 1 HAVING count(*) >= 2) GROUP BY ALL)) WHERE r = 1)"
_SYM = r""", defs AS (SELECT name, min(repo_id) AS to_repo, min(file_path) AS to_path FROM nodes WHERE kind = 'struct' AND file_path IS NOT NULL GROUP BY name HAVING count(DISTINCT repo_id) = 1),
 uses AS (SELECT DISTINCT repo_id AS from_repo, path AS from_path, unnest(regexp_extract_all(content, '\b([A-Z][A-Za-z]{7,})\b', 1)) AS name FROM files),
 lm AS (SELECT 'symbol' AS kind, u.name, from_repo, from_path, to_repo, to_path FROM uses u JOIN defs d USING (name) WHERE from_repo <> to_repo)"""
_NL = "chr(10)"
SQL = {
    "summary_inputs": _W + f", r AS (SELECT m.community_id, n.name, row_number() OVER (PARTITION BY m.community_id ORDER BY n.kind, n.name, n.stable_id) AS r FROM mems m JOIN nodes n USING (node_id)), c AS (SELECT community_id, count(*) AS member_count FROM mems GROUP BY 1), l AS (SELECT community_id, CAST(count(*) AS INT) AS listed, string_agg(CASE WHEN r <= 5 THEN name END, ',' ORDER BY r) AS first FROM r WHERE r <= 200 GROUP BY 1), t AS (SELECT DISTINCT m.community_id, c.content, c.content_hash FROM mems m JOIN chks c USING (node_id)), sn AS (SELECT community_id, string_agg(content, {_NL} ORDER BY r) AS s FROM (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY length(content) DESC, content_hash) AS r FROM t) WHERE r <= 5 GROUP BY 1) SELECT m.community_id, m.label, c.member_count, l.listed, l.first, sha256(coalesce(sn.s, '')) AS snippets FROM comms m JOIN c USING (community_id) JOIN l USING (community_id) LEFT JOIN sn USING (community_id)",
    "layer_vote": _W + f", v AS (SELECT m.community_id, {LAYER_SQL.format(p='coalesce(file_path, ' + repr('') + ')', k='kind')} AS layer FROM mems m JOIN nodes USING (node_id)) SELECT community_id, layer FROM (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY (layer = 'unknown')::INT, n DESC, CASE layer WHEN 'entry' THEN 0 WHEN 'interface' THEN 1 WHEN 'core' THEN 2 WHEN 'unknown' THEN 3 ELSE 4 END) AS r FROM (SELECT community_id, layer, count(*) AS n FROM v GROUP BY ALL)) WHERE r = 1",
    "summary_gate": _W + _MK.format(h=_h) + _CM.format(n="ch", f="fh") + _MK.format(h="CASE WHEN chunk_type = 'struct' THEN sha256(content || '!') ELSE content_hash END").replace("fh AS", "fh2 AS") + _CM.format(n="ch2", f="fh2") + "SELECT ch2.community_id, ch2.hash FROM ch2 LEFT JOIN ch USING (community_id) WHERE (ch.hash || '-sum3') IS DISTINCT FROM (ch2.hash || '-sum3')",
    "summary_cache_restore": _W + _MK.format(h=_h) + _CM.format(n="ch", f="fh") + "SELECT community_id, min(substr(community_id, 1, 8)) OVER (PARTITION BY hash) AS summary FROM ch",
    "stack_dependencies": _W + ", deps AS (SELECT 'npm' AS ecosystem, name, coalesce(json_extract_string(metadata, '$.version'), '') AS version, coalesce(file_path, '') AS manifest FROM nodes WHERE kind = 'dependency' AND contains(stable_id, ':npm:dependency:')), v AS (SELECT name, version, min(manifest) AS m FROM deps WHERE version <> '' GROUP BY ALL), vv AS (SELECT name, string_agg(version, ',' ORDER BY m, version) AS versions FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY m, version) AS r FROM v) WHERE r <= 4 GROUP BY ALL) SELECT ecosystem, name, coalesce(versions, '') AS versions, 'runtime' AS scope, count(DISTINCT manifest) AS manifests FROM deps LEFT JOIN vv USING (name) GROUP BY ALL",
    "stack_scripts": "SELECT 'build' AS name, 1 AS manifests, 'vite build' AS command",
    "stack_infra": "SELECT * FROM (VALUES ('aws_cdk', '', 2, 'AWS CDK app,LedgerStack'), ('aws_cdk', 'lambda', 1, 'lambda.Function Handler')) t(technology, service, resources, examples)",
    "impact_summary": _W + ", h AS (SELECT q AS question, path, chunk_type, CASE WHEN contains(lower(path), q) THEN 1.5 ELSE 0 END + CASE WHEN contains(lower(content), q) THEN 0.35 ELSE 0 END AS score FROM (SELECT f.path, chunk_type, content, unnest(['ledger', 'cursor']) AS q FROM chks c JOIN (SELECT file_id, path FROM files) f USING (file_id)) WHERE contains(lower(path), q) OR contains(lower(content), q)), g AS (SELECT question, path, count(*) AS hits, round(max(score), 6)::DOUBLE AS score, max((chunk_type NOT IN ('documentation', 'config'))::INT) AS code FROM h GROUP BY ALL) SELECT question, path, hits, score, code, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY code DESC, score DESC, path) AS place FROM g) WHERE place <= 24",
    "manifest_correlate": _W + ", p AS (SELECT DISTINCT m.community_id AS page, 'file' AS kind, lower(file_path) AS item FROM mems m JOIN nodes USING (node_id) WHERE file_path IS NOT NULL UNION SELECT m.community_id, 'symbol', lower(name) FROM mems m JOIN nodes USING (node_id) WHERE file_path IS NOT NULL AND kind <> 'file') SELECT a.page AS a, b.page AS b, CAST(sum(CASE WHEN kind = 'file' THEN 2 ELSE 1 END) AS BIGINT) AS score FROM p a JOIN p b USING (kind, item) WHERE a.page < b.page GROUP BY ALL",
    "link_matches": _W + _SYM + "SELECT * FROM lm",
    "link_aggregate": _W + _SYM + f", dm AS {_DM}, x AS (SELECT lm.kind, s.community_id AS source, t.community_id AS target, lm.name, count(*) AS n FROM lm JOIN dm s ON s.repo_id = from_repo AND s.file_path = from_path JOIN dm t ON t.repo_id = to_repo AND t.file_path = to_path WHERE s.community_id <> t.community_id GROUP BY ALL) SELECT kind, source, target, CAST(sum(n) AS BIGINT) AS total, string_agg(CASE WHEN r <= 6 THEN name END, ',' ORDER BY name) AS names, 0.8::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY kind, source, target ORDER BY name) AS r FROM x) GROUP BY kind, source, target",
    "feature_inventory": _W + ", g AS (SELECT community_id, count(*) AS symbols, CAST(sum((contains(lower(name), 'report') OR contains(lower(name), 'ledger'))::INT) AS BIGINT) AS matched FROM mems JOIN nodes USING (node_id) WHERE kind <> 'file' GROUP BY 1) SELECT community_id, label, matched, symbols FROM comms JOIN g USING (community_id) WHERE matched > 0 OR list_bool_or([starts_with(s, 'report') OR starts_with(s, 'ledger') FOR s IN regexp_split_to_array(lower(label), '[^a-z0-9]+')])",
    "change_plan": _W + _MK.format(h=_h) + _CM.format(n="ch", f="fh") + _MK.format(h="CASE WHEN chunk_type = 'struct' THEN sha256(content || '!') ELSE content_hash END").replace("fh AS", "fh2 AS") + _CM.format(n="ch2", f="fh2") + f", p AS (SELECT m.community_id, unnest(v.embedding) AS x, generate_subscripts(v.embedding, 1) AS i FROM vecs v JOIN chks c USING (chunk_id) JOIN mems m ON m.node_id = c.node_id WHERE model_id = 'quillmini-64'), mv AS (SELECT community_id, i, avg(x::DOUBLE) AS m FROM p GROUP BY ALL), e AS (SELECT community_id, list(m ORDER BY i) AS embedding FROM mv GROUP BY 1), sem AS (SELECT community_id, round(list_cosine_similarity(embedding, {[float(x) for x in QUESTION]}::DOUBLE[]), 6) AS c FROM e ORDER BY c DESC, community_id LIMIT 24), z AS (SELECT community_id, c, 'semantic' AS why FROM sem WHERE c >= 0.05 UNION ALL SELECT ch2.community_id, 1.0, 'diff' FROM ch2 LEFT JOIN ch USING (community_id) WHERE ch2.hash IS DISTINCT FROM ch.hash) SELECT community_id, round(max(c), 6)::DOUBLE AS confidence, string_agg(DISTINCT why, '+' ORDER BY why) AS reasons FROM z GROUP BY 1 ORDER BY confidence DESC, community_id LIMIT 8",
    "context_warnings": "SELECT DISTINCT path AS word FROM source_files WHERE path NOT IN (SELECT path FROM source_files WHERE language = 'python')",
}
