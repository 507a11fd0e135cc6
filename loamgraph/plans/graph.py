from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import merkle as M
from ..sources import relations as R
from . import expected as A
from . import fixture as X
from .catalog import _W


def _labels(s, d):
    return R.nodes(s, d).filter("file_path is not null").select("node_id", F.element_at(F.split("file_path", "/"), 1).alias("label"))


def _cliques(s):
    """Three triangles, the middle one on thin bridges to the others."""
    inside = [(3 * k + i, 3 * k + j, 1.0) for k in range(3) for i in range(3) for j in range(i)]
    rows = [("r", f"n{min(a, b)}", f"n{max(a, b)}", w, 1) for a, b, w in [*inside, (2, 3, 0.1), (5, 6, 0.1)]]
    return s.createDataFrame(rows, "repo_id string, a string, b string, weight double, links long")


def _seeds(s, d):
    return R.nodes(s, d).filter("kind = 'method'").select("node_id", "repo_id")


def _order(s, d):
    from pyspark.sql import Window

    links = G.directed_links(R.edges(s, d), R.members(s, d)).join(R.communities(s, d).select(F.col("community_id").alias("a"), "repo_id"), "a")
    w = Window.partitionBy("repo_id").orderBy(F.desc("size"), "community_id")
    items = R.communities(s, d).withColumn("priority", F.row_number().over(w)).filter("priority <= 40").select(F.col("repo_id").alias("plan"), F.col("community_id").alias("item"), "priority")
    return G.reading_order(items, links.select(F.col("repo_id").alias("plan"), F.col("a").alias("item"), F.col("b").alias("needs")))


def _labelled(s, d):
    """Label of a community: the commonest leading folder of its members."""
    top = F.element_at(F.split("file_path", "/"), 1)
    rows = R.members(s, d).join(R.nodes(s, d).filter("file_path is not null").select("node_id", "file_path"), "node_id").groupBy("community_id", top.alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("community_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "folder")).alias("b")).select("community_id", F.col("b.folder").alias("folder"), (-F.col("b.n")).alias("n"))


def _languages(s, d):
    rows = R.members(s, d).join(R.nodes(s, d).select("node_id", F.get_json_object("metadata", "$.language").alias("language")), "node_id").filter("language is not null").groupBy("community_id", "language").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("community_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "language")).alias("b")).select("community_id", F.col("b.language").alias("language"), (-F.col("b.n")).alias("n"))


def _edited(s, d):
    """The chunks after an edit of every struct's."""
    c = R.chunks(s, d)
    return c.withColumn("content_hash", F.when(F.col("chunk_type") == "struct", F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.col("content_hash")))


def _files_hash(s, d, c=None):
    return M.file_hashes(R.files(s, d), c if c is not None else R.chunks(s, d))


def _comm_hash(s, d, c=None):
    return M.community_hashes(R.members(s, d), R.nodes(s, d), _files_hash(s, d, c))


def _points(s, d):
    return R.chunks(s, d).filter("node_id is not null").join(R.files(s, d).select("file_id", F.col("path").alias("file_path")), "file_id").select(F.col("chunk_id").alias("key"), "repo_id", "file_path", F.col("line_start").alias("line"))


QUERIES = {
    "pair_weights": lambda s, d: G.pair_weights(R.edges(s, d)),
    "quotient_edges": lambda s, d: G.quotient(R.edges(s, d), R.members(s, d)),
    "directed_links": lambda s, d: G.directed_links(R.edges(s, d), R.members(s, d)),
    "modularity": lambda s, d: G.modularity(G.pair_weights(R.edges(s, d)), _labels(s, d)),
    "internal_edges": lambda s, d: G.internal_edges(R.edges(s, d), R.members(s, d)),
    "one_hop_neighbors": lambda s, d: G.one_hop(R.edges(s, d), _seeds(s, d)),
    "shortest_paths": lambda s, d: G.cheapest_paths(R.edges(s, d), _seeds(s, d)),
    "call_edges": lambda s, d: X.named_edges(X.graph(s)).filter("kind = 'calls'").select("source_id", "target_id"),
    "louvain_cliques": lambda s, d: G.louvain(_cliques(s), s.createDataFrame([(f"n{i}", f"n{i}") for i in range(9)], "node_id string, stable_id string")).select("node_id", "label"),
    "louvain_modularity": lambda s, d: G.modularity(_cliques(s), G.louvain(_cliques(s), s.createDataFrame([(f"n{i}", f"n{i}") for i in range(9)], "node_id string, stable_id string")).select("node_id", "label")),
    "topo_order_cycle": lambda s, d: G.reading_order(s.createDataFrame([("p", x, i + 1) for i, x in enumerate("abcde")], "plan string, item string, priority int"), s.createDataFrame([("p", "a", "c"), ("p", "c", "d"), ("p", "b", "a"), ("p", "d", "c"), ("p", "a", "c"), ("p", "e", "e")], "plan string, item string, needs string")).select("item", "place"),
    "cut_tree_folders": lambda s, d: G.cut_tree(s.createDataFrame([("r", p) for p in ("a/b/1", "a/b/2", "a/c/3", "a/c/d/4", "e/5", "6")], "repo_id string, path string"), 2),
    "innermost_symbol": lambda s, d: G.innermost(_points(s, d), R.nodes(s, d).filter("kind <> 'file' and line_start is not null").select("node_id", "repo_id", "file_path", "stable_id", "line_start", "line_end")),
    "community_label": _labelled,
    "dominant_language": _languages,
    "louvain": lambda s, d: G.louvain(G.pair_weights(R.edges(s, d)), R.nodes(s, d)),
    "topo_order": _order,
    "cut_tree": lambda s, d: G.cut_tree(R.files(s, d).select("repo_id", "path").distinct()),
    "package_root": lambda s, d: G.package_root(R.files(s, d).select("repo_id", "path").distinct(), R.files(s, d).filter(F.col("path").rlike("(^|/)(cdk|config|settings)[.]json$")).select("repo_id", F.regexp_replace("path", "/?[^/]*$", "").alias("root"))),
    "merkle_file": _files_hash,
    "merkle_community": _comm_hash,
    "merkle_root": lambda s, d: M.root_hashes(_files_hash(s, d)),
    "merkle_diff": lambda s, d: M.changed(_comm_hash(s, d), _comm_hash(s, d, _edited(s, d)), "community_id"),
    "blast_radius": lambda s, d: M.blast_radius(M.changed(_comm_hash(s, d), _comm_hash(s, d, _edited(s, d)), "community_id"), R.members(s, d)),
}

_MK = """, fh AS (SELECT f.repo_id, f.file_id, f.path, sha256(coalesce((SELECT string_agg({h}, chr(10) ORDER BY coalesce(line_start, -1), coalesce(line_end, -1), chunk_type, {h}) FROM chks c WHERE c.file_id = f.file_id), '')) AS hash FROM files f)"""
_CM = ", {n} AS (SELECT community_id, sha256(string_agg(hash, chr(10) ORDER BY path, hash)) AS hash FROM (SELECT DISTINCT m.community_id, {f}.path, {f}.hash FROM mems m JOIN nodes n USING (node_id) JOIN {f} ON {f}.repo_id = m.repo_id AND {f}.path = n.file_path) GROUP BY community_id)"
_h = "content_hash"
_edit = "CASE WHEN chunk_type = 'struct' THEN sha256(content || '!') ELSE content_hash END"
_DIFF = _MK.format(h=_h) + _CM.format(n="ch", f="fh") + _MK.format(h=_edit).replace("fh AS", "fh2 AS") + _CM.format(n="ch2", f="fh2")
_coup = "least(greatest(confidence, 0), 1) / greatest(cost, 1e-6)"
_pairs = f", pw AS (SELECT repo_id, least(source, target) AS a, greatest(source, target) AS b, round(sum({_coup}), 6) AS weight, count(*) AS links FROM edges WHERE source <> target GROUP BY ALL)"
SQL = {
    "pair_weights": _W + _pairs + "SELECT * FROM pw",
    "quotient_edges": _W + f", k AS (SELECT least(x.community_id, y.community_id) AS a, greatest(x.community_id, y.community_id) AS b, kind, sum({_coup}) AS w, count(*) AS n FROM edges e JOIN mems x ON x.node_id = e.source JOIN mems y ON y.node_id = e.target WHERE x.community_id <> y.community_id GROUP BY ALL) SELECT a, b, round(sum(w), 6) AS weight, CAST(sum(n) AS BIGINT) AS links, (list(kind ORDER BY n DESC, kind))[1] AS kind FROM k GROUP BY a, b",
    "directed_links": _W + "SELECT x.community_id AS a, y.community_id AS b, count(*) AS n FROM edges e JOIN mems x ON x.node_id = e.source JOIN mems y ON y.node_id = e.target WHERE x.community_id <> y.community_id GROUP BY ALL",
    "modularity": _W + _pairs + ", l AS (SELECT node_id, string_split(file_path, '/')[1] AS label FROM nodes WHERE file_path IS NOT NULL), p AS (SELECT pw.repo_id, weight, x.label AS la, y.label AS lb FROM pw JOIN l x ON x.node_id = a JOIN l y ON y.node_id = b), m AS (SELECT repo_id, sum(weight) AS m FROM p GROUP BY 1), dg AS (SELECT repo_id, label, sum(weight) AS deg FROM (SELECT repo_id, la AS label, weight FROM p UNION ALL SELECT repo_id, lb, weight FROM p) GROUP BY ALL), ins AS (SELECT repo_id, la AS label, sum(weight) AS i FROM p WHERE la = lb GROUP BY ALL) SELECT repo_id, round(sum(coalesce(i, 0) / m - power(deg / (2 * m), 2)), 6) AS modularity FROM dg JOIN m USING (repo_id) LEFT JOIN ins USING (repo_id, label) GROUP BY repo_id",
    "internal_edges": _W + "SELECT community_id, count(*) AS pairs FROM (SELECT DISTINCT x.community_id, least(source, target) AS a, greatest(source, target) AS b FROM edges e JOIN mems x ON x.node_id = e.source JOIN mems y ON y.node_id = e.target AND x.community_id = y.community_id WHERE source <> target) GROUP BY 1",
    "one_hop_neighbors": _W + ", sd AS (SELECT node_id FROM nodes WHERE kind = 'method') SELECT DISTINCT n AS node_id FROM (SELECT target AS n FROM edges WHERE source IN (SELECT node_id FROM sd) UNION ALL SELECT source FROM edges WHERE target IN (SELECT node_id FROM sd)) WHERE n NOT IN (SELECT node_id FROM sd)",
    # ways of up to six edges; longer ones are dearer than any here
    "shortest_paths": _W.replace("WITH ", "WITH RECURSIVE ", 1) + ", sd AS (SELECT node_id FROM nodes WHERE kind = 'method'), arcs AS (SELECT source, target, min(cost) AS cost FROM (SELECT source, target, cost FROM edges UNION ALL SELECT target, source, cost + 0.15 FROM edges) GROUP BY ALL), w AS (SELECT source AS s, target AS t, round(cost, 9) AS c, 1 AS h FROM arcs WHERE source IN (SELECT node_id FROM sd) UNION SELECT w.s, b.target, round(w.c + b.cost, 9), h + 1 FROM w JOIN arcs b ON w.t = b.source WHERE h < 6 AND b.target <> w.s) SELECT s AS start, t AS \"end\", round(min(c), 6) AS cost, CAST(min_by(h, (c, h)) AS INT) AS hops FROM w WHERE s <> t AND t IN (SELECT node_id FROM sd) GROUP BY s, t",
    "call_edges": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for k, a, b, _, _ in A.EDGES if k == "calls") + ") t(source_id, target_id)",
    # two triangles and one more on a thin bridge
    "louvain_cliques": "SELECT * FROM (VALUES ('n0', 'n0'), ('n1', 'n0'), ('n2', 'n0'), ('n3', 'n3'), ('n4', 'n3'), ('n5', 'n3'), ('n6', 'n6'), ('n7', 'n6'), ('n8', 'n6')) t(node_id, label)",
    # 9 links of weight 1 inside and 2 of weight 0.1 between: 9 / 9.2 - 2 (6.1 / 18.4)^2 - (6.2 / 18.4)^2
    "louvain_modularity": "SELECT 'r' AS repo_id, round(9 / 9.2 - 2 * (6.1 / 18.4) * (6.1 / 18.4) - (6.2 / 18.4) * (6.2 / 18.4), 6)::DOUBLE AS modularity",
    # only e needs nothing; then nothing is ready, as c and d need each other, and the best priority left goes on
    "topo_order_cycle": "SELECT * FROM (VALUES ('e', 1), ('a', 2), ('b', 3), ('c', 4), ('d', 5)) t(item, place)",
    "cut_tree_folders": "SELECT * FROM (VALUES ('r', 'a/b/1', 'a/b'), ('r', 'a/b/2', 'a/b'), ('r', 'a/c/3', 'a/c'), ('r', 'a/c/d/4', 'a/c'), ('r', 'e/5', 'e'), ('r', '6', '')) t(repo_id, path, folder)",
    "innermost_symbol": _W + "SELECT key, node_id FROM (SELECT c.chunk_id AS key, n.node_id, row_number() OVER (PARTITION BY c.chunk_id ORDER BY n.line_end - n.line_start, n.stable_id) AS r FROM chks c JOIN files f USING (file_id) JOIN nodes n ON n.repo_id = c.repo_id AND n.file_path = f.path AND c.line_start BETWEEN n.line_start AND n.line_end WHERE c.node_id IS NOT NULL AND n.kind <> 'file') WHERE r = 1",
    "community_label": _W + "SELECT community_id, folder, n FROM (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY n DESC, folder) AS r FROM (SELECT community_id, string_split(file_path, '/')[1] AS folder, count(*) AS n FROM mems JOIN nodes USING (node_id) WHERE file_path IS NOT NULL GROUP BY ALL)) WHERE r = 1",
    "dominant_language": _W + "SELECT community_id, language, n FROM (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY n DESC, language) AS r FROM (SELECT community_id, json_extract_string(metadata, '$.language') AS language, count(*) AS n FROM mems JOIN nodes USING (node_id) GROUP BY ALL) WHERE language IS NOT NULL) WHERE r = 1",
    "package_root": _W + ", r AS (SELECT DISTINCT repo_id, regexp_replace(path, '/?[^/]*$', '') AS root FROM files WHERE regexp_matches(path, '(^|/)(cdk|config|settings)[.]json$')) SELECT f.repo_id, f.path, max_by(r.root, length(r.root)) AS root FROM (SELECT DISTINCT repo_id, path FROM files) f JOIN r ON r.repo_id = f.repo_id AND (r.root = '' OR starts_with(f.path, r.root || '/')) GROUP BY ALL",
    "merkle_file": _W + _MK.format(h=_h) + "SELECT * FROM fh",
    "merkle_community": _W + _MK.format(h=_h) + _CM.format(n="ch", f="fh") + "SELECT * FROM ch",
    "merkle_root": _W + _MK.format(h=_h) + ", lo AS (SELECT repo_id, substr(sha256(path), 1, 2) AS b, sha256(string_agg(hash, chr(10) ORDER BY path, hash)) AS h FROM fh GROUP BY ALL) SELECT repo_id, sha256(string_agg(h, chr(10) ORDER BY b)) AS hash FROM lo GROUP BY repo_id",
    "merkle_diff": _W + _DIFF + "SELECT community_id FROM ch2 LEFT JOIN ch USING (community_id) WHERE ch2.hash IS DISTINCT FROM ch.hash",
    "blast_radius": _W + _DIFF + "SELECT community_id, count(*) AS size FROM mems WHERE community_id IN (SELECT community_id FROM ch2 LEFT JOIN ch USING (community_id) WHERE ch2.hash IS DISTINCT FROM ch.hash) GROUP BY 1 HAVING count(*) >= 2",
}
