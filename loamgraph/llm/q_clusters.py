from __future__ import annotations

from ..session import table
from . import clusters as C

QUERIES = {
    "p3_found": lambda s, d: C.clusters(table(s, d, "detected_communities")).select("cluster_id", "detection_id").distinct(),
    "p3_clusters": lambda s, d: C.cluster_report(table(s, d, "detected_communities")),
}
SQL = {
    "p3_found": """
      WITH RECURSIVE d AS (SELECT DISTINCT detection_id, repo_id, list_sort(list_distinct(member_node_ids)) AS m
                           FROM detected_communities WHERE len(member_node_ids) > 0),
      t AS (SELECT detection_id, repo_id, len(m) AS n, unnest(m) AS x FROM d),
      e AS (SELECT a.detection_id AS u, b.detection_id AS v FROM t a JOIN t b ON a.repo_id = b.repo_id AND a.x = b.x AND a.detection_id <> b.detection_id
            GROUP BY a.detection_id, b.detection_id, a.n, b.n HAVING count(*) >= 0.5 * (a.n + b.n - count(*))),
      r AS (SELECT u, u AS v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
      SELECT min(v) AS cluster_id, u AS detection_id FROM r GROUP BY u""",
}
