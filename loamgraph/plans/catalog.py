from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layers as L
from ..functions import text as T
from ..operators import catalog as C
from ..session import table
from ..sources import relations as R

_W = f"WITH {R.SQL} "
_big = "(SELECT community_id FROM mems GROUP BY community_id HAVING count(*) >= 2)"


def _repo_stats(s, d):
    n, c, e = R.nodes(s, d), R.chunks(s, d), R.embeddings(s, d)
    count = lambda df, name: df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name))
    embedded = c.join(e.select("chunk_id").distinct(), "chunk_id", "left_semi")
    out = table(s, d, "repositories").select("repo_id").distinct()
    for df, name in (
        (R.files(s, d), "files"), (n, "nodes"), (c, "chunks"), (embedded, "embedded"), (c.filter(F.get_json_object("metadata", "$.part").isNotNull()), "split_chunks"),
        (c.filter("node_id is not null").select("repo_id", "node_id").distinct(), "nodes_with_chunk"), (R.communities(s, d), "communities"),
    ):
        out = out.join(count(df, name), "repo_id", "left")
    return out.na.fill(0)


def _count_union(s, d, names):
    out = None
    for t in names:
        one = table(s, d, t).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


_TABLES = ["repositories", "analysis_runs", "source_files", "graph_nodes", "chunks", "chunk_embeddings", "detected_communities", "run_chunks"]


def _hier(s, d):
    m = R.members(s, d)
    return C.top_members(m, R.nodes(s, d), 5)


QUERIES = {
    "scan_nodes": lambda s, d: R.nodes(s, d).select("repo_id", "stable_id", "node_id", "kind", "name"),
    "scan_edges": lambda s, d: R.edges(s, d),
    "scan_incident_edges": lambda s, d: C.incident_edges(R.edges(s, d), R.nodes(s, d).filter("kind = 'struct'")),
    "scan_chunks_ilike": lambda s, d: C.chunks_like(R.chunks(s, d), R.files(s, d), ["cursor", "ledger"]),
    "scan_graph_export": lambda s, d: C.graph_export(R.nodes(s, d), R.chunks(s, d)),
    "scan_hierarchy": _hier,
    "scan_manifests": lambda s, d: R.files(s, d).filter(F.col("path").rlike(r"(^|/)(package\.json|Cargo\.toml|cdk\.json|config\.json)$")).select("repo_id", "path").distinct(),
    "lookup_repo": lambda s, d: table(s, d, "repositories").filter("name like '%-forge' or root_path like '%/basalt%'").groupBy("name").agg(F.max_by("repo_id", "updated_at").alias("repo_id")),
    "group_counts": lambda s, d: R.nodes(s, d).groupBy("repo_id", F.col("kind").alias("label")).agg(F.count(F.lit(1)).alias("n")),
    "repo_stats": _repo_stats,
    "table_counts": lambda s, d: _count_union(s, d, _TABLES),
    "missing_embeddings": lambda s, d: C.missing_embeddings(R.chunks(s, d), R.embeddings(s, d), "ollama", "quillmini-64"),
    "embedding_reuse": lambda s, d: C.reusable_embeddings(R.chunks(s, d), R.embeddings(s, d)),
    "embedder_identities": lambda s, d: R.embeddings(s, d).select("provider", "model_id", "dimensions").distinct(),
    "dominant_community": lambda s, d: C.dominant_community(R.nodes(s, d), R.members(s, d)),
    "distinct_files": lambda s, d: R.members(s, d).join(R.nodes(s, d).filter("file_path is not null").select("node_id", "file_path"), "node_id").groupBy("community_id").agg(F.countDistinct("file_path").alias("files"), F.min("file_path").alias("first")),
    "folder_scope": lambda s, d: R.files(s, d).filter(C.in_folder(F.col("path"), "./Packages/core/")).select("file_id", "path"),
    "json_key": lambda s, d: R.chunks(s, d).filter(F.get_json_object("metadata", "$.part").isNotNull()).select("chunk_id", F.get_json_object("metadata", "$.part").cast("int").alias("part")),
    "top_folders": lambda s, d: C.top_folders(R.files(s, d)),
    "language_counts": lambda s, d: R.files(s, d).groupBy("repo_id", T.language_of(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("files")),
    "run_states": lambda s, d: C.last_run(table(s, d, "analysis_runs")),
    "merge_files_snapshot": lambda s, d: C.without_files(R.edges(s, d), R.nodes(s, d), R.files(s, d).filter("language = 'rust'").select("repo_id", F.col("path").alias("file_path")).distinct()),
    "node_dedup": lambda s, d: C.first_per_stable_id(R.nodes(s, d)).select("repo_id", "stable_id", "node_id"),
    "upsert_nodes": lambda s, d: C.merged_node(
        R.nodes(s, d).filter("kind <> 'method'"),
        R.nodes(s, d).filter("kind in ('method', 'function')").select("repo_id", "stable_id", F.concat(F.lit("new-"), "node_id").alias("node_id"), F.lit("concept").alias("kind"), F.upper("name").alias("name"), (F.col("line_start") + 1).alias("line_start"), F.lit(None).cast("int").alias("line_end")),
    ),
    "symbol_layers": lambda s, d: R.nodes(s, d).select("node_id", L.of_path(F.coalesce("file_path", F.lit("")), F.col("kind")).alias("layer")),
    "test_files": lambda s, d: R.files(s, d).select("file_id", T.is_test_path(F.col("path")).alias("is_test"), T.is_indexable(F.col("path")).alias("indexable"), T.dir_of(F.col("path")).alias("dir")),
}

_CONTAINS = "strpos(lower(content), 'cursor') > 0 OR strpos(lower(content), 'ledger') > 0"
_named = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
from ..functions import vocabulary as V  # noqa: E402

_pl = dict(V.PATH_LAYERS)
LAYER_SQL = (
    "CASE WHEN {p} = '' THEN CASE WHEN {k} = 'deployment_resource' THEN 'foundation' ELSE 'unknown' END "
    + f"WHEN list_has_any(string_split(lower({{p}}), '/'), {_named(_pl['core'])}) THEN 'core' "
    + f"WHEN list_has_any(string_split(lower({{p}}), '/'), {_named(_pl['interface'])}) OR contains(lower({{p}}), '/pages/api/') THEN 'interface' "
    + f"WHEN list_has_any(string_split(lower({{p}}), '/'), {_named(_pl['entry'])}) THEN 'entry' "
    + f"WHEN lower({{p}}) LIKE '%.sol' OR lower({{p}}) LIKE '%.tf' OR {{k}} = 'deployment_resource' OR list_has_any(string_split(lower({{p}}), '/'), {_named(_pl['foundation'])}) THEN 'foundation' "
    + "ELSE 'unknown' END"
)
LANG_SQL = "CASE regexp_extract({p}, '\\.([A-Za-z]+)$', 1) WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'mts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'sol' THEN 'solidity' WHEN 'md' THEN 'markdown' ELSE 'unknown' END"
SQL = {
    "scan_nodes": _W + "SELECT repo_id, stable_id, node_id, kind, name FROM nodes",
    "scan_edges": _W + "SELECT * FROM edges",
    "scan_incident_edges": _W + "SELECT DISTINCT e.* FROM edges e WHERE source IN (SELECT node_id FROM nodes WHERE kind = 'struct') OR target IN (SELECT node_id FROM nodes WHERE kind = 'struct')",
    "scan_chunks_ilike": _W + f"SELECT coalesce(f.path, '') AS path, c.line_start, c.content_hash, c.chunk_id FROM chks c LEFT JOIN files f USING (file_id) WHERE {_CONTAINS.replace('content', 'c.content')}",
    "scan_graph_export": _W + "SELECT n.node_id, n.repo_id, n.kind, n.name, coalesce(n.file_path, '') AS path, count(c.chunk_id) AS chunks FROM nodes n LEFT JOIN chks c ON c.node_id = n.node_id GROUP BY ALL",
    "scan_hierarchy": _W + f"SELECT community_id, CAST(place AS INT) AS place, kind, name FROM (SELECT m.community_id, n.kind, n.name, row_number() OVER (PARTITION BY m.community_id ORDER BY n.kind, n.name, n.stable_id) AS place FROM mems m JOIN nodes n USING (node_id) WHERE n.kind <> 'file' AND m.community_id IN {_big}) WHERE place <= 5",
    "scan_manifests": r"SELECT DISTINCT repo_id, path FROM source_files WHERE regexp_matches(path, '(^|/)(package\.json|Cargo\.toml|cdk\.json|config\.json)$')",
    "lookup_repo": "SELECT name, max_by(repo_id, updated_at) AS repo_id FROM repositories WHERE name LIKE '%-forge' OR root_path LIKE '%/basalt%' GROUP BY name",
    "group_counts": _W + "SELECT repo_id, kind AS label, count(*) AS n FROM nodes GROUP BY ALL",
    "repo_stats": _W + """SELECT r.repo_id, (SELECT count(*) FROM files x WHERE x.repo_id = r.repo_id) AS files, (SELECT count(*) FROM nodes x WHERE x.repo_id = r.repo_id) AS nodes,
        (SELECT count(*) FROM chks x WHERE x.repo_id = r.repo_id) AS chunks, (SELECT count(*) FROM chks x WHERE x.repo_id = r.repo_id AND x.chunk_id IN (SELECT chunk_id FROM vecs)) AS embedded,
        (SELECT count(*) FROM chks x WHERE x.repo_id = r.repo_id AND json_extract_string(metadata, '$.part') IS NOT NULL) AS split_chunks,
        (SELECT count(DISTINCT node_id) FROM chks x WHERE x.repo_id = r.repo_id) AS nodes_with_chunk, (SELECT count(*) FROM comms x WHERE x.repo_id = r.repo_id) AS communities
        FROM (SELECT DISTINCT repo_id FROM repositories) r""",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in _TABLES),
    "missing_embeddings": _W + "SELECT c.chunk_id, c.repo_id, c.content_hash FROM chks c WHERE NOT EXISTS (SELECT 1 FROM vecs v WHERE v.chunk_id = c.chunk_id AND v.content_hash = c.content_hash AND provider = 'ollama' AND model_id = 'quillmini-64')",
    "embedding_reuse": _W + "SELECT DISTINCT c.chunk_id, v.provider, v.model_id, v.embedding_id FROM chks c JOIN (SELECT content_hash, provider, model_id, dimensions, min(embedding_id) AS embedding_id FROM vecs GROUP BY ALL) v USING (content_hash)",
    "embedder_identities": _W + "SELECT DISTINCT provider, model_id, dimensions FROM vecs",
    "dominant_community": _W + f"SELECT repo_id, file_path, community_id, c AS members FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY c DESC, community_id) AS r FROM (SELECT m.repo_id, n.file_path, m.community_id, count(*) AS c FROM mems m JOIN nodes n USING (node_id) WHERE n.file_path IS NOT NULL AND community_id IN {_big} GROUP BY ALL)) WHERE r = 1",
    "distinct_files": _W + "SELECT community_id, count(DISTINCT file_path) AS files, min(file_path) AS first FROM mems JOIN nodes n USING (node_id) WHERE file_path IS NOT NULL GROUP BY community_id",
    "folder_scope": _W + "SELECT file_id, path FROM files WHERE path ILIKE 'packages/core/%' OR lower(path) = 'packages/core'",
    "json_key": _W + "SELECT chunk_id, CAST(json_extract_string(metadata, '$.part') AS INT) AS part FROM chks WHERE json_extract_string(metadata, '$.part') IS NOT NULL",
    "top_folders": _W + "SELECT repo_id, folder, n, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, folder) AS place FROM (SELECT repo_id, array_to_string(string_split(path, '/')[1:least(2, len(string_split(path, '/')) - 1)], '/') AS folder, count(*) AS n FROM files WHERE contains(path, '/') GROUP BY ALL)) WHERE place <= 4",
    "language_counts": _W + f"SELECT repo_id, {LANG_SQL.format(p='path')} AS language, count(*) AS files FROM files GROUP BY ALL",
    "run_states": "SELECT run_id, repo_id, max_by(status, CASE status WHEN 'completed' THEN 2 WHEN 'failed' THEN 1 ELSE 0 END) AS status, max(finished_at) AS finished_at FROM analysis_runs GROUP BY ALL",
    "merge_files_snapshot": _W + ", gone AS (SELECT node_id FROM nodes n WHERE EXISTS (SELECT 1 FROM files f WHERE f.language = 'rust' AND f.repo_id = n.repo_id AND f.path = n.file_path)) SELECT source, target, repo_id, kind, cost, confidence FROM edges WHERE source NOT IN (SELECT node_id FROM gone) AND target NOT IN (SELECT node_id FROM gone)",
    "node_dedup": _W + "SELECT repo_id, stable_id, min(node_id) AS node_id FROM nodes GROUP BY ALL",
    "upsert_nodes": _W + ", o AS (SELECT * FROM nodes WHERE kind <> 'method'), n AS (SELECT repo_id, stable_id, 'new-' || node_id AS node_id, 'concept' AS kind, upper(name) AS name, line_start + 1 AS line_start, CAST(NULL AS INT) AS line_end FROM nodes WHERE kind IN ('method', 'function')) SELECT coalesce(o.repo_id, n.repo_id) AS repo_id, coalesce(o.stable_id, n.stable_id) AS stable_id, coalesce(o.node_id, n.node_id) AS node_id, coalesce(n.kind, o.kind) AS kind, coalesce(n.name, o.name) AS name, coalesce(o.line_start, n.line_start) AS line_start, coalesce(o.line_end, n.line_end) AS line_end FROM o FULL JOIN n ON o.repo_id = n.repo_id AND o.stable_id = n.stable_id",
    "symbol_layers": _W + f"SELECT node_id, {LAYER_SQL.format(p="coalesce(file_path, '')", k='kind')} AS layer FROM nodes",
    "test_files": _W + r"""SELECT file_id, (contains(path, '.test.') OR contains(path, '.spec.') OR contains(path, '__tests__/') OR contains(path, '__test__/') OR lower(path) LIKE '%\_test.py' ESCAPE '\' OR contains(lower(path), '/test_') OR starts_with(lower(path), 'test_') OR contains(lower(path), '/tests/')) AS is_test,
        (regexp_extract(path, '[^/]*$') IN ('package.json', 'Cargo.toml', 'cdk.json', 'tsconfig.json', 'jsconfig.json') OR regexp_matches(path, '\.(rs|ts|tsx|mts|cts|js|jsx|mjs|cjs)$') OR regexp_matches(lower(path), '\.(md|mdx|sol|pdf|py|pyi)$')) AS indexable,
        CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir FROM files""",
}
