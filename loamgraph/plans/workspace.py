from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import merkle as M
from ..operators import workspace as W
from ..session import table
from ..sources import relations as R
from .catalog import _W
from .graph import _MK, _edited, _h


def _linked(s, d):
    """Projects by the last word of a repository's name, linked before an edit of every struct."""
    roots = M.root_hashes(M.file_hashes(R.files(s, d), R.chunks(s, d)))
    names = table(s, d, "repositories").select("repo_id", F.element_at(F.split("name", "-"), -1).alias("project")).distinct()
    return names.join(roots.withColumnRenamed("hash", "linked_hash"), "repo_id", "left")


def _now(s, d):
    return M.root_hashes(M.file_hashes(R.files(s, d), _edited(s, d)))


def _scores(s, d):
    c = R.communities(s, d)
    return c.select(F.element_at(F.split("label", "/"), -1).alias("area"), "community_id", (F.size("members") / 100.0).alias("score"))


QUERIES = {
    "stale_links": lambda s, d: W.stale_links(_now(s, d), _linked(s, d)),
    "event_terms": lambda s, d: R.nodes(s, d).filter("kind = 'struct'").select("node_id", W.event_term(F.lit("search"), F.concat(F.lit('{"pattern": "^'), "name", F.lit('$"}'))).alias("term")),
    "branch_names": lambda s, d: R.nodes(s, d).select("node_id", W.humanized_branch(F.concat(F.lit("feature/"), "name")).alias("title")),
    "auto_domains": lambda s, d: W.domains(R.files(s, d).select(F.col("file_id").alias("card"), "path"), 40),
    "structure_report": lambda s, d: W.structure(R.members(s, d), R.nodes(s, d)),
    "page_scores": lambda s, d: W.page_scores(R.communities(s, d).select(F.col("community_id").alias("page"), F.col("label").alias("head"), "members").join(R.members(s, d).join(R.nodes(s, d).select("node_id", "name"), "node_id").groupBy(F.col("community_id").alias("page")).agg(F.array_sort(F.collect_list("name")).alias("items")), "page"), ["report", "ledger"]),
    "components": lambda s, d: W.components(R.communities(s, d), _scores(s, d), G.directed_links(R.edges(s, d), R.members(s, d))),
}
SQL = {
    "stale_links": _W + _MK.format(h=_h) + _MK.format(h="CASE WHEN chunk_type = 'struct' THEN sha256(content || '!') ELSE content_hash END").replace("fh AS", "fh2 AS") + ", r1 AS (SELECT repo_id, string_agg(hash, ',' ORDER BY path, hash) AS h FROM fh GROUP BY 1), r2 AS (SELECT repo_id, string_agg(hash, ',' ORDER BY path, hash) AS h FROM fh2 GROUP BY 1) SELECT string_split(name, '-')[-1] AS project, max((r1.h IS DISTINCT FROM r2.h)::INT) AS stale, count(*) AS repositories FROM (SELECT DISTINCT repo_id, name FROM repositories) p LEFT JOIN r1 USING (repo_id) LEFT JOIN r2 USING (repo_id) GROUP BY 1",
    "event_terms": _W + "SELECT node_id, CASE WHEN length(name) >= 3 THEN name END AS term FROM nodes WHERE kind = 'struct'",
    "branch_names": _W + "SELECT node_id, trim(translate(string_split('feature/' || name, '/')[-1], '-_', '  ')) AS title FROM nodes",
    "structure_report": _W + ", z AS (SELECT repo_id, community_id, count(*) AS n FROM mems GROUP BY ALL), sp AS (SELECT m.repo_id, m.community_id, count(DISTINCT string_split(file_path, '/')[1]) AS f FROM mems m JOIN nodes n USING (node_id) WHERE file_path IS NOT NULL GROUP BY ALL) SELECT repo_id, count(*) AS communities, (list(n ORDER BY n, community_id))[count(*) // 2 + 1] AS median, max(n) AS largest, CAST(sum((n >= 80)::INT) AS BIGINT) AS blobs, coalesce((SELECT CAST(sum((f > 1)::INT) AS BIGINT) FROM sp WHERE sp.repo_id = z.repo_id), 0) AS glue FROM z GROUP BY repo_id",
    "page_scores": _W + ", i AS (SELECT community_id, lower(string_agg(name, ' ' ORDER BY name)) AS t FROM mems JOIN nodes USING (node_id) GROUP BY 1) SELECT page, CAST(score AS INT) AS score FROM (SELECT community_id AS page, 3 * list_sum([(len(lower(label)) - len(replace(lower(label), x, ''))) // len(x) FOR x IN ['report', 'ledger']]) + list_sum([(len(t) - len(replace(t, x, ''))) // len(x) FOR x IN ['report', 'ledger']]) AS score FROM comms JOIN i USING (community_id)) WHERE score > 0",
    "components": _W + ", sc AS (SELECT string_split(label, '/')[-1] AS area, community_id, label, len(members) / 100.0 AS score FROM comms), ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY score DESC, community_id) AS place FROM sc) WHERE place <= 40), dl AS (SELECT DISTINCT x.community_id AS a, y.community_id AS b FROM edges e JOIN mems x ON x.node_id = e.source JOIN mems y ON y.node_id = e.target WHERE x.community_id <> y.community_id) SELECT area, community_id, label, CAST(place AS INT) AS place, (SELECT count(*) FROM dl JOIN ch o ON o.community_id = dl.b WHERE dl.a = ch.community_id AND o.area = ch.area) AS needs FROM ch",
}
