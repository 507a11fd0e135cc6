"""Extraction and writes on the fixture tree, and writes over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embedding as E
from ..operators import links as L
from ..operators import search as Q
from ..operators import stack as P
from ..operators import summary as S
from ..operators import vector as V
from ..operators import workspace as K
from ..operators import writes as W
from ..session import table
from ..sinks import notes as N
from ..sources import relations as R
from . import expected as A
from . import fixture as X
from .catalog import _W


def _values(rows: list[tuple], names: list[str]) -> str:
    one = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") t({', '.join(names)})"


NODE = ["kind", "stable_id", "name", "file_path", "line_start", "line_end"]
EDGE = ["kind", "source_id", "target_id", "cost", "confidence"]
CHUNK = ["chunk_type", "file_path", "line_start", "line_end", "content_hash"]


def _graph(s):
    g = X.graph(s)
    return {**g, "embeddings": E.embed_missing(g["chunks"], s.createDataFrame([], "embedding_id string, chunk_id string, provider string, model_id string, dimensions int, content_hash string, embedding array<float>"), E.WordHashes(16))}


def _replaced(s):
    """The tree again with two files edited: of the old vectors those of unchanged texts serve the new chunks."""
    paths = {p for p, _ in X.EDITED}
    batch = X.graph(s, [x for x in X.TREE if x[0] not in paths] + X.EDITED)
    return W.replace_index(_graph(s), batch, X.repositories(s))


def _merged(s):
    """Only the edited files are indexed anew."""
    paths = s.createDataFrame([(X.REPOSITORY, p) for p, _ in X.EDITED], "repo_id string, path string")
    return W.merge_files(_graph(s), X.graph(s, X.EDITED), paths)


# The merge resolves calls among the given files only, and an edge from an unchanged file into a replaced symbol goes.
_GONE = {("calls", "app/main.py:function:run", "app/store.py:function:load")}
_NEW_NODES = [
    ("function", "app/extra.py:function:keep", "keep", "app/extra.py", 4, 5),
    ("dependency", "app/extra.py:import:8acf464cfd6923ddcae23bab9f570ffde0d7576e1f1b23d82e9afcc7b477ca09", ".store", "app/extra.py", 1, 1),
    ("function", "app/store.py:function:save", "save", "app/store.py", 5, 6),
    ("file", "file:app/extra.py", "app/extra.py", "app/extra.py", 1, 5),
]
_NEW_EDGES = [
    ("calls", "app/extra.py:function:keep", "app/store.py:function:save", 0.35, 0.7),
    ("calls", "app/store.py:function:save", "app/store.py:function:load", 0.35, 0.7),
    ("contains", "file:app/extra.py", "app/extra.py:function:keep", 0.1, 1.0),
    ("imports", "file:app/extra.py", "app/extra.py:import:8acf464cfd6923ddcae23bab9f570ffde0d7576e1f1b23d82e9afcc7b477ca09", 0.35, 1.0),
    ("contains", "file:app/store.py", "app/store.py:function:save", 0.1, 1.0),
    ("contains", "repo", "file:app/extra.py", 0.1, 1.0),
]
_EDITED_NODES = [(*r[:5], 6) if r[1] == "file:app/store.py" else r for r in A.NODES] + _NEW_NODES


def _tables(s, d):
    """The given tables as a graph; chunks know the path of their file."""
    at = R.files(s, d).select("file_id", F.col("path").alias("file_path"))
    return {
        "files": R.files(s, d).select("file_id", "repo_id", "path", "content_hash"), "nodes": R.nodes(s, d), "edges": R.edges(s, d).withColumn("metadata", F.lit(None).cast("string")),
        "chunks": R.chunks(s, d).join(at, "file_id", "left").select("chunk_id", "repo_id", "file_path", "node_id", "chunk_type", "content", "content_hash", "line_start", "line_end", "metadata"),
        "embeddings": R.embeddings(s, d),
    }


def _again(s, d):
    """Every repository indexed anew: the same texts in chunks with new ids."""
    g = _tables(s, d)
    batch = {**g, "chunks": g["chunks"].withColumn("chunk_id", F.concat(F.lit("new-"), "chunk_id"))}
    return W.replace_index(g, batch, table(s, d, "repositories"))["embeddings"].select("chunk_id", "provider", "model_id", "dimensions", "content_hash")


def _rust_again(s, d):
    """All Rust files indexed anew, their nodes and chunks with new ids."""
    g = _tables(s, d)
    paths = R.files(s, d).filter("language = 'rust'").select("repo_id", "path").distinct()
    place = paths.select("repo_id", F.col("path").alias("file_path"))
    new = lambda c: F.concat(F.lit("new-"), c)
    n = g["nodes"].join(place, ["repo_id", "file_path"], "left_semi")
    batch = {
        "files": g["files"].join(paths, ["repo_id", "path"], "left_semi"), "nodes": n.withColumn("node_id", new("node_id")),
        "edges": g["edges"].join(n.select(F.col("node_id").alias("source")), "source", "left_semi").join(n.select(F.col("node_id").alias("target")), "target", "left_semi").withColumns({"source": new("source"), "target": new("target")}),
        "chunks": g["chunks"].join(place, ["repo_id", "file_path"], "left_semi").withColumns({"chunk_id": new("chunk_id"), "node_id": new("node_id")}),
    }
    m = W.merge_files(g, batch, paths)
    one = lambda name, key: m[name].select(F.lit(name).alias("relation"), key.alias("key"))
    return one("files", F.col("file_id")).unionByName(one("nodes", F.col("node_id"))).unionByName(one("edges", F.concat_ws(">", "source", "target", "kind"))).unionByName(one("chunks", F.concat_ws("@", "chunk_id", "node_id"))).unionByName(one("embeddings", F.col("embedding_id")))


def _communities(s, d):
    """The latest detections over the first ones, which had a summary."""
    first = table(s, d, "detected_communities").filter("member_node_ids is not null").groupBy("community_id").agg(F.min_by(F.struct("repo_id", "label", "detection_id"), F.struct("detected_at", "detection_id")).alias("f"))
    old = first.select("community_id", "f.repo_id", "f.label", F.lit("h").alias("subtree_hash"), F.col("f.label").alias("summary"), F.concat(F.lit("h:"), "f.detection_id").alias("summary_hash"))
    gone = old.limit(0).unionByName(s.createDataFrame([("vanished", None, "x", "h", "s", "h")], old.schema))
    repo = table(s, d, "repositories").select("repo_id")
    detected = R.communities(s, d).select("community_id", "repo_id", "label")
    return W.replace_communities(old.unionByName(gone.withColumn("repo_id", F.lit("nowhere"))), detected, repo).select("community_id", "label", "summary", "summary_hash")


def _repositories(s, d):
    old = table(s, d, "repositories").dropDuplicates(["repo_id"])
    late = (F.col("updated_at") + F.expr("INTERVAL 1 DAY")).alias("updated_at")
    new = old.filter("remote_url is not null").select(F.concat(F.lit("new-"), "repo_id").alias("repo_id"), F.upper("name").alias("name"), "root_path", "remote_url", F.lit("f00").alias("current_commit_sha"), F.col("updated_at").alias("created_at"), late)
    return W.upsert_repositories(old, new).select("repo_id", "name", "root_path", "current_commit_sha", "created_at", "updated_at")


def _inserted(s, d):
    """Every usable vector once more, for a new text."""
    e = R.embeddings(s, d)
    new = e.filter("provider = 'openai'").withColumns({"embedding_id": F.concat(F.lit("new-"), "embedding_id"), "content_hash": F.sha2("content_hash", 256)})
    return W.insert_embeddings(e, new.unionByName(e.filter("provider = 'openai'"))).select("chunk_id", "provider", "model_id", "content_hash")


def _states(s):
    """Three communities: unchanged, known to the cache, new."""
    hashes = s.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3"), ("d", "h4")], "community_id string, hash string")
    summaries = s.createDataFrame([("a", "h1-sum3"), ("b", "h0-sum3"), ("d", "h4-sum3")], "community_id string, summary_hash string")
    return W.summary_counts(hashes, summaries, s.createDataFrame([("h2", "text")], "hash string, summary string"), s.createDataFrame([("a",), ("b",)], "community_id string"))


def _links(s):
    rows = s.createDataFrame([("p", "abi", "a", "b", 0.8), ("p", "package_dep", "a", "c", 0.9), ("q", "abi", "x", "y", 0.8), ("p", "http_route", "b", "a", 0.65)], "project_id string, kind string, source string, target string, confidence double")
    return W.load_links(W.replace_links(rows, "q", s.createDataFrame([("abi", "x", "z", 0.8)], "kind string, source string, target string, confidence double")))


def _cards(s):
    """Fifteen cards in one folder and three apart."""
    rows = [(f"c{i:02d}", f"app/{'ui' if i < 5 else 'api'}/f{i}.ts") for i in range(15)] + [("d1", "lib/a.py"), ("d2", "lib/b.py"), ("e1", "tools/x/y.py")]
    return K.domains(s.createDataFrame(rows, "card string, path string"))


def _composed(s):
    member = "struct<name:string,kind:string,path:string>"
    rows = s.createDataFrame([("c", "app/ledger", 3, [("load", "function", "app/b.py"), ("app/a.py", "file", "app/a.py"), ("Store", "struct", "app/a.py")], ["def load(): ..."])], f"community_id string, label string, member_count int, members array<{member}>, snippets array<string>")
    return S.composed(rows, s.createDataFrame([("c", "core")], "community_id string, layer string"))


def _peers(s):
    comms = s.createDataFrame([("a", "one", ["x", "y"]), ("b", "two", ["z"]), ("c", "three", ["q"])], "community_id string, label string, members array<string>")
    return N.community_notes(comms, s.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0)], "a string, b string, weight double"))


def _pooled(s):
    rows = [("q1", "core", 0.70), ("q1", "core", 0.60), ("q1", "entry", 0.66), ("q1", "interface", 0.63), ("q2", "core", 0.64), ("q3", "entry", 0.90), ("q3", "core", 0.80)]
    return V.routed_layers(s.createDataFrame(rows, "query string, layer string, score double"))


def _retained(s):
    """Nine hits for five places: none of the first five is a document, so the best later one comes just before the cut."""
    rows = [("q", f"h{i}", 1.0 - i / 10, i in (6, 8)) for i in range(9)]
    return Q.retained_documents(s.createDataFrame(rows, "question string, chunk_id string, score double, supplemental boolean"), 5)


#: (repo, path, text) of three repositories that use each other.
SHARED = [
    ("api", "package.json", '{"name": "@acme/api-kit"}'), ("core", "crates/core/Cargo.toml", '[package]\nname = "ledger-core"\n'), ("web", "package.json", '{"name": "ab"}'), ("web", "x/package.json", "{"),
    ("api", "src/routes.ts", "app.get('/api/users/:id', f);\napp.post('/login', g);\n"), ("web", "src/a.ts", "import { k } from '@acme/api-kit/deep';\nfetch('/api/users/42');\nfetch('/nothing');\n"),
    ("web", "src/b.rs", "use ledger_core::Ledger;\n"), ("core", "crates/core/src/lib.rs", "use ledger_core::own;\n"), ("web", "src/c.ts", "fetch(`/v1/api/users/${id}`); fetch('/log')\n"), ("web", "src/d.js", "const k = require('@acme/api-kit');\n"),
]


def _shared(s):
    return s.createDataFrame(SHARED, "repo_id string, path string, content string")


def _code(s):
    return _shared(s).filter("path rlike '[.](ts|js|rs)$'")


QUERIES = {
    "published_packages": lambda s, d: L.packages(_shared(s)),
    "registered_routes": lambda s, d: L.routes(_code(s)),
    "called_routes": lambda s, d: L.calls(_code(s)),
    "package_links": lambda s, d: L.package_matches(L.packages(_shared(s)), _code(s)),
    "route_links": lambda s, d: L.route_matches(L.calls(_code(s)), L.routes(_code(s))),
    "package_communities": lambda s, d: L.package_places(s.createDataFrame([("c1", "n1"), ("c1", "n2"), ("c2", "n3"), ("c2", "n4"), ("c2", "n5"), ("c3", "n6")], "community_id string, node_id string"), s.createDataFrame([(f"n{i}", "r", p) for i, p in ((1, "a/x.ts"), (2, "a/y.ts"), (3, "a/b/z.ts"), (4, "q.ts"), (5, "q.ts"), (6, "a/w.ts"))], "node_id string, repo_id string, file_path string"), s.createDataFrame([("r", "a"), ("r", ""), ("r", "a/b"), ("r", "zz")], "repo_id string, dir string")),
    "domains_of_cards": lambda s, d: _cards(s),
    "composed_text": lambda s, d: _composed(s),
    "peer_notes": lambda s, d: _peers(s),
    "pooled_layers": lambda s, d: _pooled(s),
    "retained_hits": lambda s, d: _retained(s),
    "extract_nodes": lambda s, d: X.graph(s)["nodes"].select(NODE),
    "extract_edges": lambda s, d: X.named_edges(X.graph(s)).select(EDGE),
    "extract_chunks": lambda s, d: X.graph(s)["chunks"].select(CHUNK),
    "replace_index": lambda s, d: _replaced(s)["nodes"].select(NODE),
    "replace_index_vectors": lambda s, d: _replaced(s)["embeddings"].join(_replaced(s)["chunks"].select("chunk_id", "chunk_type", "file_path", "line_start", "line_end"), "chunk_id").select(CHUNK),
    "merge_files": lambda s, d: _merged(s)["nodes"].select(NODE),
    "merge_files_edges": lambda s, d: X.named_edges(_merged(s)).select(EDGE),
    "reindex_vectors": _again,
    "merge_rust_files": _rust_again,
    "replace_communities": _communities,
    "upsert_repositories": _repositories,
    "insert_embeddings": _inserted,
    "purged_rows": lambda s, d: (lambda g: g["chunks"].select("chunk_id").unionByName(g["embeddings"].select("chunk_id")).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")))(W.purge(_tables(s, d), table(s, d, "repositories").filter("remote_url is null"))),
    "community_hash_update": lambda s, d: W.with_hashes(R.communities(s, d).select("community_id", F.col("label").alias("subtree_hash")), R.members(s, d).groupBy("community_id").agg(F.max("node_id").alias("hash")).filter("hash > '8'"), "community_id", "subtree_hash"),
    "embed_missing_counts": lambda s, d: E.embed_missing(R.chunks(s, d), R.embeddings(s, d), E.WordHashes(32)).groupBy("provider", "model_id", "dimensions").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("size")),
    "summary_states": lambda s, d: _states(s),
    "project_links": lambda s, d: _links(s),
    "stack_report": lambda s, d: P.report(X.graph(s)["nodes"], X.graph(s)["chunks"]),
    "stack_overview": lambda s, d: P.overview("ledger", X.graph(s)["nodes"]),
    "stack_deployments": lambda s, d: P.deployments(X.graph(s)["nodes"]).drop("repo_id"),
    "stack_declared_scripts": lambda s, d: P.scripts(X.graph(s)["nodes"]).drop("repo_id"),
    "humanized_labels": lambda s, d: R.communities(s, d).select("community_id", S.humanized(F.col("label")).alias("title")),
}

SQL = {
    "published_packages": "SELECT * FROM (VALUES ('api', '@acme/api-kit', ''), ('core', 'ledger-core', 'crates/core')) t(repo_id, name, dir)",
    "registered_routes": "SELECT * FROM (VALUES ('api', '/api/users/*', 'src/routes.ts'), ('api', '/login', 'src/routes.ts')) t(repo_id, route, path)",
    # what follows .get( and .post( counts as called too
    "called_routes": "SELECT * FROM (VALUES ('api', '/api/users/*', 'src/routes.ts'), ('api', '/login', 'src/routes.ts'), ('web', '/api/users/42', 'src/a.ts'), ('web', '/nothing', 'src/a.ts'), ('web', '/v1/api/users/*', 'src/c.ts'), ('web', '/log', 'src/c.ts')) t(repo_id, route, path)",
    "package_links": "SELECT * FROM (VALUES ('package_dep', '@acme/api-kit', 'web', 'src/a.ts', 'api', ''), ('package_dep', '@acme/api-kit', 'web', 'src/d.js', 'api', ''), ('package_dep', 'ledger-core', 'web', 'src/b.rs', 'core', 'crates/core')) t(kind, name, from_repo, from_path, to_repo, to_dir)",
    "route_links": "SELECT * FROM (VALUES ('http_route', '/api/users/*', 'web', 'src/a.ts', 'api', 'src/routes.ts'), ('http_route', '/api/users/*', 'web', 'src/c.ts', 'api', 'src/routes.ts')) t(kind, name, from_repo, from_path, to_repo, to_path)",
    "package_communities": "SELECT * FROM (VALUES ('r', 'a', 'c2'), ('r', '', 'c2'), ('r', 'a/b', 'c2')) t(repo_id, dir, community_id)",
    "domains_of_cards": "SELECT * FROM (VALUES " + ", ".join(f"('c{i:02d}', 'app/{'ui' if i < 5 else 'api'}')" for i in range(15)) + ", ('d1', 'lib'), ('d2', 'lib'), ('e1', 'other')) t(card, domain)",
    "composed_text": "SELECT 'c' AS community_id, 'app/ledger (app ledger)' || chr(10) || 'Role: core logic.' || chr(10) || 'Key symbols: load, Store.' || chr(10) || 'Files: app/a.py, app/b.py.' || chr(10) || 'Composition: 1 file, 1 function, 1 struct (3 members).' || chr(10) || 'Representative code:' || chr(10) || 'def load(): ...' || chr(10) AS summary",
    "peer_notes": "SELECT * FROM (VALUES ('a', '# one' || chr(10) || 'members: 2' || chr(10) || '## Peers' || chr(10) || '- three' || chr(10) || '- two' || chr(10)), ('b', '# two' || chr(10) || 'members: 1' || chr(10) || '## Peers' || chr(10) || '- one' || chr(10)), ('c', '# three' || chr(10) || 'members: 1' || chr(10) || '## Peers' || chr(10) || '- one' || chr(10))) t(community_id, note)",
    "pooled_layers": "SELECT * FROM (VALUES ('q1', 'core', 0.70::DOUBLE, 2), ('q1', 'entry', 0.66, 0), ('q3', 'entry', 0.90, 0)) t(query, layer, score, rank)",
    "retained_hits": "SELECT * FROM (VALUES ('q', 'h0', 1), ('q', 'h1', 2), ('q', 'h2', 3), ('q', 'h3', 4), ('q', 'h6', 5)) t(question, chunk_id, place)",
    "extract_nodes": _values(A.NODES, NODE),
    "extract_edges": _values(A.EDGES, EDGE),
    "extract_chunks": _values(A.CHUNKS, CHUNK),
    # what was not edited, by its text, keeps its vector
    "replace_index_vectors": _values([r for r in A.CHUNKS if r[1] != "app/store.py"], CHUNK),
    "replace_index": _values(_EDITED_NODES, NODE),
    "merge_files": _values(_EDITED_NODES, NODE),
    "merge_files_edges": _values([r for r in A.EDGES if r[:3] not in _GONE] + _NEW_EDGES, EDGE),
    "reindex_vectors": _W + "SELECT 'new-' || c.chunk_id AS chunk_id, v.provider, v.model_id, v.dimensions, c.content_hash FROM chks c JOIN (SELECT DISTINCT o.repo_id, o.content_hash, v.provider, v.model_id, v.dimensions FROM vecs v JOIN chks o USING (chunk_id)) v ON v.repo_id = c.repo_id AND v.content_hash = c.content_hash UNION ALL SELECT chunk_id, provider, model_id, dimensions, content_hash FROM vecs WHERE chunk_id NOT IN (SELECT chunk_id FROM chks)",
    "merge_rust_files": _W + """, rp AS (SELECT DISTINCT repo_id, path FROM files WHERE language = 'rust'), dead AS (SELECT node_id, repo_id, stable_id FROM nodes n WHERE EXISTS (SELECT 1 FROM rp WHERE rp.repo_id = n.repo_id AND rp.path = n.file_path)),
        inner_e AS (SELECT * FROM edges WHERE source IN (SELECT node_id FROM dead) AND target IN (SELECT node_id FROM dead)),
        cp AS (SELECT c.chunk_id, c.repo_id, c.node_id, f.path FROM chks c LEFT JOIN files f USING (file_id)), rc AS (SELECT * FROM cp WHERE EXISTS (SELECT 1 FROM rp WHERE rp.repo_id = cp.repo_id AND rp.path = cp.path))
        SELECT 'files' AS relation, file_id AS key FROM files UNION ALL
        SELECT 'nodes', node_id FROM nodes WHERE node_id NOT IN (SELECT node_id FROM dead) UNION ALL SELECT 'nodes', 'new-' || min(node_id) FROM dead GROUP BY repo_id, stable_id UNION ALL
        SELECT 'edges', source || '>' || target || '>' || kind FROM edges WHERE source NOT IN (SELECT node_id FROM dead) AND target NOT IN (SELECT node_id FROM dead) UNION ALL
        SELECT 'edges', 'new-' || source || '>' || 'new-' || target || '>' || kind FROM inner_e UNION ALL
        SELECT 'chunks', concat_ws('@', chunk_id, CASE WHEN node_id NOT IN (SELECT node_id FROM dead) THEN node_id END) FROM cp WHERE chunk_id NOT IN (SELECT chunk_id FROM rc) UNION ALL
        SELECT 'chunks', concat_ws('@', 'new-' || chunk_id, CASE WHEN node_id IN (SELECT node_id FROM dead) THEN 'new-' || node_id END) FROM rc UNION ALL
        SELECT 'embeddings', embedding_id FROM vecs WHERE chunk_id NOT IN (SELECT chunk_id FROM rc)""",
    "replace_communities": _W + ", f AS (SELECT community_id, label, detection_id FROM (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY detected_at, detection_id) AS r FROM detected_communities WHERE member_node_ids IS NOT NULL) WHERE r = 1) SELECT c.community_id, c.label, f.label AS summary, 'h:' || f.detection_id AS summary_hash FROM comms c JOIN f USING (community_id) UNION ALL SELECT 'vanished', 'x', 's', 'h'",
    "upsert_repositories": "SELECT DISTINCT repo_id, CASE WHEN remote_url IS NULL THEN name ELSE upper(name) END AS name, root_path, CASE WHEN remote_url IS NULL THEN current_commit_sha ELSE 'f00' END AS current_commit_sha, created_at, CASE WHEN remote_url IS NULL THEN updated_at ELSE updated_at + INTERVAL 1 DAY END AS updated_at FROM repositories",
    "insert_embeddings": _W + "SELECT DISTINCT chunk_id, provider, model_id, content_hash FROM vecs WHERE provider = 'openai' UNION ALL SELECT chunk_id, provider, model_id, content_hash FROM vecs WHERE provider <> 'openai' UNION ALL SELECT DISTINCT chunk_id, provider, model_id, sha256(content_hash) FROM vecs WHERE provider = 'openai'",
    "purged_rows": _W + ", gone AS (SELECT chunk_id FROM chks WHERE repo_id IN (SELECT repo_id FROM repositories WHERE remote_url IS NULL)) SELECT chunk_id, count(*) AS n FROM (SELECT chunk_id FROM chks UNION ALL SELECT chunk_id FROM vecs) WHERE chunk_id NOT IN (SELECT chunk_id FROM gone) GROUP BY 1",
    "community_hash_update": _W + "SELECT community_id, coalesce(CASE WHEN m > '8' THEN m END, label) AS subtree_hash FROM comms LEFT JOIN (SELECT community_id, max(node_id) AS m FROM mems GROUP BY 1) USING (community_id)",
    "embed_missing_counts": _W + "SELECT 'local' AS provider, 'word-hashes' AS model_id, 32 AS dimensions, count(*) AS n, 32 AS size FROM chks",
    "summary_states": "SELECT * FROM (VALUES ('a', 'h1', 'skipped'), ('b', 'h2', 'reused'), ('c', 'h3', 'pending'), ('d', 'h4', 'pending')) t(community_id, hash, state)",
    "project_links": "SELECT * FROM (VALUES ('p', 'package_dep', 'a', 'c', 0.9::DOUBLE), ('p', 'abi', 'a', 'b', 0.8), ('q', 'abi', 'x', 'z', 0.8), ('p', 'http_route', 'b', 'a', 0.65)) t(project_id, kind, source, target, confidence)",
    "stack_report": "SELECT * FROM (VALUES ('package', 'cargo:proptest', 'dev', 1::BIGINT), ('package', 'cargo:serde', 'runtime', 1), ('package', 'cargo:tokio', 'runtime', 1), ('package', 'npm:@acme/kit', '1.0.0 runtime', 1), ('package', 'npm:react', '^18.0.0 runtime', 1), ('script', 'build', 'vite build', 1), ('resource', 'aws_cdk:', 'AWS CDK app,LedgerStack', 2), ('resource', 'aws_cdk:lambda', 'lambda.Function Handler', 1), ('config', 'web/tsconfig.json', '', 1)) t(section, name, detail, n)",
    "stack_overview": "SELECT * FROM (VALUES ('ledger declares 3 cargo packages, 1 of them for development only.'), ('ledger declares 2 npm packages, 0 of them for development only.'), ('ledger deploys 3 resources with aws_cdk.')) t(sentence)",
    "stack_deployments": "SELECT * FROM (VALUES ('AWS CDK app', 'aws_cdk', 'app', '', 'npx ts-node bin/app.ts', 'infra/cdk.json', 2), ('LedgerStack', 'aws_cdk', 'stack', '', '', 'infra/stack.ts', 4), ('lambda.Function Handler', 'aws_cdk', 'construct', 'lambda', '', 'infra/stack.ts', 7)) t(name, technology, resource_kind, service, app, file, line_start)",
    "stack_declared_scripts": "SELECT * FROM (VALUES ('build', 'vite build', 'web/package.json')) t(name, command, manifest)",
    "humanized_labels": _W + "SELECT community_id, CASE WHEN array_to_string(list_filter(regexp_split_to_array(label, '[^A-Za-z0-9]+'), lambda x: x <> ''), ' ') <> label THEN label || ' (' || array_to_string(list_filter(regexp_split_to_array(label, '[^A-Za-z0-9]+'), lambda x: x <> ''), ' ') || ')' ELSE label END AS title FROM comms",
}
