"""Lookups, projects, the stack and what a filter selects, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lookups as K
from ..operators import stack as P
from ..operators import vector as X
from ..operators import writes as W
from ..session import table
from ..sources import extract as E
from ..sources import graph_rows as G
from ..sources import relations as R
from . import fixture as FX
from .catalog import _W, LAYER_SQL

SKIP = [".git", "target", "node_modules", ".venv", "dist", "build"]  # fixed values: directories that are skipped by default


def _repos(s, d):
    return table(s, d, "repositories")


def _projects(s, d):
    """A project for every last word of the repositories' names."""
    names = _repos(s, d).select(F.element_at(F.split("name", "-"), -1).alias("name"))
    return W.create_projects(s.createDataFrame([("p0", "ledger")], "project_id string, name string"), names)


def _members(s, d):
    rows = _repos(s, d).select("repo_id", F.col("name").alias("alias"), F.element_at(F.split("name", "-"), -1).alias("name")).join(_projects(s, d), "name")
    none = s.createDataFrame([], "project_id string, repo_id string, alias string, linked_hash string")
    return W.add_repositories(none, rows)


def _stack(s, d):
    return P.dependencies(R.nodes(s, d))


CONTRACTS = [("Vault", "a.sol", "solidity", "contract"), ("PayVault", "a.sol", "solidity", "contract"), ("Governor", "b.sol", "solidity", "interface"), ("IVault", None, "solidity", "interface"), ("payVaultLong", "c.sol", "solidity", "library"), ("PayEvent", "c.sol", "solidity", "event"), ("PayVault", "d.ts", "typescript", "contract")]
FLAGS = [(1, "x", "core", None, None), (2, "x", " ", "src", "t"), (3, " ", None, None, None), (4, "the client layer", None, None, None), (5, "access control", None, None, None), (6, "a/b", None, None, None), (7, "docs", None, None, None)]


def _flags(s):
    rows = s.createDataFrame(FLAGS, "no int, q string, layer string, folder string, topic string")
    r = K.resolved_filter(F.col("q"), F.col("layer"), F.col("folder"), F.col("topic"), T.words("docs"))
    return rows.select("no", r.alias("r")).select("no", "r.kind", "r.value", "r.detected")


def _curated(s):
    cards = s.createDataFrame([("c1", "app · Run", 1), ("c2", "Run", 2), ("c3", "lib · Store", 3)], "card string, label string, order int")
    wanted = s.createDataFrame([(1, 1, "A", "Run", None), (1, 2, "A", "Run", None), (2, 1, "B", "Store", "n"), (2, 2, "B", "Store", None)], "group_no int, place int, title string, label string, note string")
    return K.curated(cards, wanted).select("group_no", "place", "card")


QUERIES = {
    "fixture_external_imports": lambda s, d: E.records(FX.files(s, FX.TREE)).filter("record = 'import' and path like '%.ts'").select(F.col("name").alias("module"), (T.is_bare(F.col("name")) & ~F.col("name").startswith("@acme/web")).alias("external")).distinct(),
    "resolved_flags": lambda s, d: _flags(s),
    "curated_domains": lambda s, d: _curated(s),
    "lookup_repositories": lambda s, d: K.repositories(_repos(s, d)),
    "lookup_projects": lambda s, d: _projects(s, d).select("name"),
    "lookup_project": lambda s, d: K.project(_projects(s, d), "forge").join(_members(s, d), "project_id").select("name", "repo_id", "alias"),
    "project_members": lambda s, d: K.members_of(_members(s, d)).join(_projects(s, d), "project_id").select("name", "repo_id", "alias"),
    "projects_of_repositories": lambda s, d: W.projects_of(_members(s, d), _projects(s, d), _repos(s, d).filter("remote_url is null")).select("repo_id", "name"),
    "community_briefs": lambda s, d: K.briefs(R.communities(s, d), R.members(s, d)),
    "community_labels": lambda s, d: K.labels(R.communities(s, d), R.members(s, d)),
    "communities_for_files": lambda s, d: K.communities_for_files(R.members(s, d), R.nodes(s, d), R.files(s, d).filter("language = 'solidity'").select("repo_id", F.col("path").alias("file_path"))),
    "communities_under": lambda s, d: K.communities_under(R.members(s, d), R.nodes(s, d), ["app", "packages/core"]),
    "symbols_under": lambda s, d: K.symbols_under(R.nodes(s, d), "src"),
    "hashed_communities": lambda s, d: table(s, d, "detected_communities").filter("member_node_ids is not null").groupBy("repo_id").agg(F.countDistinct("community_id").alias("communities")),
    "manifest_dependency_nodes": lambda s, d: R.nodes(s, d).select("node_id", K.manifest_dependency(F.col("kind"), F.col("stable_id")).alias("declared")),
    "indexed_paths": lambda s, d: G.indexed(R.files(s, d), SKIP, R.chunks(s, d).filter("chunk_type <> 'config'").join(R.files(s, d).select("file_id", "path"), "file_id").select("path")).select("file_id", "path"),
    "changed_paths": lambda s, d: R.files(s, d).select("repo_id", "path", "content_hash").join(R.files(s, d).filter("language <> 'rust'").select("repo_id", "path", "content_hash"), ["repo_id", "path", "content_hash"], "left_anti").select("repo_id", "path").distinct(),
    "task_tokens": lambda s, d: R.communities(s, d).select("community_id", F.array_join(F.array_sort(T.task_tokens(F.col("label"))), ",").alias("tokens")),
    "layer_of_query": lambda s, d: R.nodes(s, d).filter("file_path is not null").select("node_id", K.layer_of_query(F.concat(F.lit("all "), F.element_at(F.split("file_path", "/"), 1), F.lit(" layer"))).alias("layer")),
    "resolved_filters": lambda s, d: R.files(s, d).select("file_id", K.resolved_filter(F.element_at(F.split("path", "/"), 1), folders=T.words("docs", "src")).alias("r")).select("file_id", "r.kind", "r.value", "r.detected"),
    "rust_uses": lambda s, d: R.files(s, d).filter("language = 'rust'").select("file_id", *[T.rust_uses(F.col("content"), F.lit(x)).alias(x) for x in ("crate", "std", "tree-sitter")]),
    "construct_files": lambda s, d: R.files(s, d).select("file_id", T.looks_like_constructs(F.col("content")).alias("cdk")),
    "external_imports": lambda s, d: E.records(R.files(s, d)).filter("record = 'import'").select("repo_id", "path", F.col("name").alias("module")).filter(F.col("path").rlike(r"[.](ts|mts|js|mjs|jsx)$")).distinct().select("repo_id", "path", "module", (T.is_bare(F.col("module")) & ~T.import_package(F.col("module")).isin("react")).alias("external")),
    "merged_metadata": lambda s, d: R.nodes(s, d).select("node_id", W.merged_metadata(F.col("metadata"), F.lit('{"language":"x","seen":1}')).alias("m")).select("node_id", F.get_json_object("m", "$.language").alias("language"), F.get_json_object("m", "$.async").alias("is_async"), F.get_json_object("m", "$.seen").cast("int").alias("seen")),
    "vector_literals": lambda s, d: table(s, d, "chunk_embeddings").filter("embedding is not null").dropDuplicates(["embedding_id"]).select("embedding_id", X.literal(F.col("embedding")).alias("text")),
    "solidity_contracts": lambda s, d: K.contracts(s.createDataFrame([("r", n, f, '{"language":"%s","solidity_kind":"%s"}' % (lang, k)) for n, f, lang, k in CONTRACTS], "repo_id string, name string, file_path string, metadata string")),
    "declared_dependencies": _stack,
    "config_files": lambda s, d: P.configs(R.chunks(s, d).join(R.files(s, d).select("file_id", F.col("path").alias("file_path")), "file_id")),
    "select_folder": lambda s, d: K.selected(R.communities(s, d), R.members(s, d), R.nodes(s, d), "folder", "app"),
    "select_layer": lambda s, d: K.selected(R.communities(s, d), R.members(s, d), R.nodes(s, d), "layer", "client"),
    "select_topic": lambda s, d: K.selected(R.communities(s, d), R.members(s, d), R.nodes(s, d), "topic", "ledger report"),
    "capped_anchors": lambda s, d: K.capped(R.nodes(s, d).filter("kind = 'struct'").select("repo_id", "name", F.coalesce("file_path", F.lit("")).alias("path")).withColumn("consumer", F.lit("all")), "consumer", 100).select("name", "path", "repo_id", "dropped"),
}

_FILLER = ", ".join(f"'{w}'" for w in K.LAYER_FILLER)
_P = ", proj AS (SELECT DISTINCT string_split(name, '-')[-1] AS name FROM repositories UNION SELECT 'ledger'), pm AS (SELECT DISTINCT string_split(name, '-')[-1] AS name, repo_id, name AS alias FROM repositories)"
_BRIEF = "SELECT community_id, label, count(DISTINCT node_id) AS member_count FROM comms JOIN mems USING (community_id, repo_id) GROUP BY ALL"
_BIG = f", big AS (SELECT community_id, label FROM ({_BRIEF}) WHERE member_count >= 2)"
from ..functions import vocabulary as V  # noqa: E402

_LAYER_WORD = "CASE " + " ".join(f"WHEN w[1] IN ({', '.join(repr(x) for x in words)}) THEN '{name}'" for name, words in V.WORD_LAYERS.items()) + " END"
_LAYER_Q = "CASE WHEN len(w) = 1 THEN " + _LAYER_WORD + " END"
_WORDS = lambda q: f"list_filter(regexp_split_to_array(lower({q}), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ({_FILLER}))"
SQL = {
    "lookup_repositories": "SELECT repo_id, max_by(name, updated_at) AS name, max_by(root_path, updated_at) AS root_path, (SELECT r2.current_commit_sha FROM repositories r2 WHERE r2.repo_id = r.repo_id ORDER BY updated_at DESC LIMIT 1) AS current_commit_sha FROM repositories r GROUP BY repo_id",
    "lookup_projects": _W + _P + "SELECT name FROM proj",
    "lookup_project": _W + _P + "SELECT * FROM pm WHERE name = 'forge'",
    "project_members": _W + _P + "SELECT * FROM pm",
    "projects_of_repositories": _W + _P + "SELECT repo_id, name FROM pm WHERE repo_id IN (SELECT repo_id FROM repositories WHERE remote_url IS NULL)",
    "community_briefs": _W + _BRIEF,
    "community_labels": _W + f"SELECT * FROM ({_BRIEF}) WHERE member_count >= 2",
    "communities_for_files": _W + "SELECT DISTINCT community_id FROM mems JOIN nodes n USING (node_id) JOIN files f ON f.repo_id = n.repo_id AND f.path = n.file_path WHERE f.language = 'solidity'",
    "communities_under": _W + "SELECT community_id, count(DISTINCT node_id) AS inside FROM mems JOIN nodes USING (node_id) WHERE lower(file_path) LIKE 'app/%' OR lower(file_path) LIKE 'packages/core/%' GROUP BY 1",
    "symbols_under": _W + "SELECT repo_id, node_id, kind, name, file_path, line_start FROM nodes WHERE kind NOT IN ('file', 'repository', 'dependency') AND lower(file_path) LIKE 'src/%'",
    "hashed_communities": "SELECT repo_id, count(DISTINCT community_id) AS communities FROM detected_communities WHERE member_node_ids IS NOT NULL GROUP BY 1",
    "manifest_dependency_nodes": _W + "SELECT node_id, kind = 'dependency' AND (contains(stable_id, ':npm:dependency:') OR contains(stable_id, ':cargo:dependency:')) AS declared FROM nodes",
    "indexed_paths": _W + f"SELECT file_id, path FROM files WHERE content IS NOT NULL AND path IN (SELECT f.path FROM chks c JOIN files f USING (file_id) WHERE chunk_type <> 'config') AND (regexp_extract(path, '[^/]*$') IN ('package.json', 'Cargo.toml', 'cdk.json', 'tsconfig.json', 'jsconfig.json') OR regexp_matches(path, '\\.(rs|ts|tsx|mts|cts|js|jsx|mjs|cjs)$') OR regexp_matches(lower(path), '\\.(md|mdx|sol|pdf|py|pyi)$')) AND NOT list_has_any(string_split(path, '/')[1:-2], {SKIP})",
    "changed_paths": _W + "SELECT DISTINCT repo_id, path FROM files f WHERE NOT EXISTS (SELECT 1 FROM files o WHERE o.language <> 'rust' AND o.repo_id = f.repo_id AND o.path = f.path AND o.content_hash = f.content_hash)",
    "task_tokens": _W + f"SELECT community_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(label), '[^a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ({', '.join(repr(w) for w in V.TASK_STOP)})))), ',') AS tokens FROM comms",
    "layer_of_query": _W + f", q AS (SELECT node_id, {_WORDS('string_split(file_path, ' + repr('/') + ')[1]')} AS w FROM nodes WHERE file_path IS NOT NULL) SELECT node_id, {_LAYER_Q} AS layer FROM q",
    "resolved_filters": _W + f", q AS (SELECT file_id, string_split(path, '/')[1] AS q, {_WORDS('string_split(path, ' + repr('/') + ')[1]')} AS w FROM files) SELECT file_id, CASE WHEN trim(q) = '' OR q IS NULL THEN 'all' WHEN contains(q, chr(92)) THEN 'folder' WHEN {_LAYER_Q} IS NOT NULL THEN 'layer' WHEN q IN ('docs', 'src') THEN 'folder' ELSE 'topic' END AS kind, CASE WHEN trim(q) <> '' THEN trim(q) END AS value, trim(q) <> '' AS detected FROM q",
    "rust_uses": _W + "SELECT file_id, " + ", ".join(f"contains(content, 'use {n}::') OR contains(content, 'use {n};') OR contains(content, 'extern crate {n}') AS \"{c}\"" for c, n in (("crate", "crate"), ("std", "std"), ("tree-sitter", "tree_sitter"))) + " FROM files WHERE language = 'rust'",
    "construct_files": _W + "SELECT file_id, contains(content, 'aws-cdk-lib') OR contains(content, '@aws-cdk/') OR contains(content, 'constructs') OR contains(content, 'extends Stack') OR contains(content, 'cdk.') AS cdk FROM files",
    "merged_metadata": _W + "SELECT node_id, 'x' AS language, json_extract_string(metadata, '$.async') AS is_async, 1 AS seen FROM nodes",
    "vector_literals": "SELECT DISTINCT embedding_id, '[' || array_to_string([CASE WHEN x IS NULL OR NOT isfinite(x) THEN '0.000' ELSE CAST(CAST(round(x::DOUBLE, 3) AS DECIMAL(12, 3)) AS VARCHAR) END FOR x IN embedding], ',') || ']' AS text FROM chunk_embeddings WHERE embedding IS NOT NULL",
    "solidity_contracts": "SELECT * FROM (VALUES ('r', 'PayVault', 'contract', 'a.sol'), ('r', 'Governor', 'interface', 'b.sol'), ('r', 'IVault', 'interface', '')) t(repo_id, name, kind, path)",
    "fixture_external_imports": "SELECT * FROM (VALUES ('react', TRUE), ('@acme/web/kit', FALSE), ('./style', FALSE), ('aws-cdk-lib', TRUE), ('aws-cdk-lib/aws-lambda', TRUE)) t(module, external)",
    "resolved_flags": "SELECT * FROM (VALUES (1, 'layer', 'core', FALSE), (2, 'folder', 'src', FALSE), (3, 'all', NULL, FALSE), (4, 'layer', 'the client layer', TRUE), (5, 'topic', 'access control', TRUE), (6, 'folder', 'a/b', TRUE), (7, 'folder', 'docs', TRUE)) t(no, kind, value, detected)",
    "curated_domains": "SELECT * FROM (VALUES (1, 1, 'c2'), (1, 2, 'c1'), (2, 1, 'c3'), (2, 2, NULL)) t(group_no, place, card)",
    "declared_dependencies": _W + "SELECT repo_id, CASE WHEN contains(stable_id, ':cargo:dependency:') THEN 'cargo' ELSE 'npm' END AS ecosystem, name, coalesce(json_extract_string(metadata, '$.version'), '') AS version, coalesce(json_extract_string(metadata, '$.section'), '') AS section, coalesce(file_path, '') AS manifest FROM nodes WHERE kind = 'dependency' AND (contains(stable_id, ':npm:dependency:') OR contains(stable_id, ':cargo:dependency:'))",
    "config_files": _W + "SELECT DISTINCT c.repo_id, coalesce(json_extract_string(c.metadata, '$.config'), f.path) AS path FROM chks c JOIN files f USING (file_id) WHERE chunk_type = 'config'",
    "select_folder": _W + _BIG + " SELECT community_id, label FROM big WHERE community_id IN (SELECT community_id FROM mems JOIN nodes USING (node_id) WHERE lower(file_path) LIKE 'app/%' OR lower(file_path) = 'app')",
    "select_layer": _W + _BIG + f", v AS (SELECT m.community_id, {LAYER_SQL.format(p='coalesce(file_path, ' + repr('') + ')', k='kind')} AS layer FROM mems m JOIN nodes USING (node_id)), vote AS (SELECT community_id, layer FROM (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY (layer = 'unknown')::INT, n DESC, CASE layer WHEN 'entry' THEN 0 WHEN 'interface' THEN 1 WHEN 'core' THEN 2 WHEN 'unknown' THEN 3 ELSE 4 END) AS r FROM (SELECT community_id, layer, count(*) AS n FROM v GROUP BY ALL)) WHERE r = 1) SELECT community_id, label FROM big JOIN vote USING (community_id) WHERE layer = 'entry'",
    "select_topic": _W + _BIG + " SELECT community_id, label FROM big WHERE community_id IN (SELECT community_id FROM mems JOIN nodes USING (node_id) WHERE kind <> 'file' AND (contains(lower(name), 'ledger') OR contains(lower(name), 'report'))) OR list_bool_or([starts_with(s, 'report') OR starts_with(s, 'ledger') FOR s IN regexp_split_to_array(lower(label), '[^a-z0-9]+')])",
    "capped_anchors": _W + ", a AS (SELECT DISTINCT name, coalesce(file_path, '') AS path, repo_id FROM nodes WHERE kind = 'struct') SELECT name, path, repo_id, greatest((SELECT count(*) FROM a) - 100, 0) AS dropped FROM a ORDER BY name, path, repo_id LIMIT 100",
}
