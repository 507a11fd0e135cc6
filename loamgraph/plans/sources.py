from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import table
from ..sinks import notes as N
from ..sources import extract as X
from ..sources import graph_rows as GR
from ..sources import relations as R
from ..streaming import feeds as S
from . import fixture as FX
from .catalog import _W

LONG = ("x" * 59 + "\n") * 50 + "y" * 2500 + "\nlast"

QUERIES = {
    "extract_symbols": lambda s, d: X.records(R.files(s, d)).filter("record = 'symbol'").drop("record"),
    "extract_imports": lambda s, d: X.records(R.files(s, d)).filter("record = 'import'").select("repo_id", "path", F.col("name").alias("module"), "line_start"),
    "extract_calls": lambda s, d: X.records(R.files(s, d)).filter("record = 'call'").groupBy("repo_id", "path", F.col("name").alias("callee")).agg(F.count(F.lit(1)).alias("calls")),
    "split_chunks": lambda s, d: X.split_chunks(R.chunks(s, d)),
    "split_long_text": lambda s, d: s.createDataFrame([(i + 1, t, json.dumps(m, sort_keys=True)) for i, (t, m) in enumerate(GR.split_content("function", LONG, {"file": "a.py"}))], "part int, content string, metadata string").select("part", F.octet_length("content").alias("bytes"), F.substring_index("content", "\n", 4).alias("head"), F.get_json_object("metadata", "$.split_total").cast("int").alias("parts"), F.get_json_object("metadata", "$.parent_content_hash").alias("parent")),
    "manifest_dependencies": lambda s, d: X.dependencies(FX.files(s, FX.TREE)).drop("repo_id"),
    "workspace_packages": lambda s, d: X.workspace_packages(FX.files(s, FX.TREE)).select("name"),
    "node_notes": lambda s, d: N.node_notes(R.nodes(s, d), R.edges(s, d)),
    "topics": lambda s, d: N.topics(R.nodes(s, d)),
    "community_notes": lambda s, d: N.community_notes(R.communities(s, d), G.quotient(R.edges(s, d), R.members(s, d))),
    "report_json": lambda s, d: N.json_rows(R.nodes(s, d).select("node_id", "kind", "name")),
    "events_tumbling": lambda s, d: S.tumbling(table(s, d, "events"), "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"),
    "events_session": lambda s, d: S.sessions(table(s, d, "events")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events")),
}
SQL = {
    "topics": _W + "SELECT repo_id, CASE WHEN contains(file_path, '/') THEN string_split(file_path, '/')[1] ELSE 'root' END AS topic, count(*) AS notes FROM nodes GROUP BY ALL",
    "workspace_packages": "SELECT '@acme/web' AS name",
    "manifest_dependencies": "SELECT * FROM (VALUES ('Cargo.toml', 'cargo', 'dependencies', 'serde', '1'), ('Cargo.toml', 'cargo', 'dependencies', 'tokio', '1.2'), ('Cargo.toml', 'cargo', 'dev-dependencies', 'proptest', '1'), ('web/package.json', 'npm', 'dependencies', 'react', '^18.0.0'), ('web/package.json', 'npm', 'dependencies', '@acme/kit', '1.0.0')) t(manifest, ecosystem, section, name, version)",
    # no text here has more than 2000 bytes, so each is its own only part
    "split_chunks": _W + "SELECT chunk_id, 1 AS part, 1 AS parts, content, sha256(content) AS content_hash, sha256(content) AS parent_hash FROM chks WHERE content IS NOT NULL AND octet_length(encode(content)) <= 2000",
    # 50 lines of 60 bytes, a line of 2500 letters and a last one: 33 lines a part, the long line in two
    "split_long_text": f"SELECT part, length(head) + 2 + n AS bytes, head, 5 AS parts, '{hashlib.sha256(LONG.encode()).hexdigest()}' AS parent FROM (SELECT part, n, 'Chunk type: function' || chr(10) || 'File: a.py' || chr(10) || 'Symbol: unknown' || chr(10) || 'Chunk part: ' || part || '/5' AS head FROM (VALUES (1, 33 * 60 - 1), (2, 17 * 60 - 1), (3, 2000), (4, 500), (5, 4)) t(part, n))",
    "report_json": _W + "SELECT to_json({node_id: node_id, kind: kind, name: name})::VARCHAR AS value FROM nodes",
    "events_tumbling": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "events_session": "SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions, count(*) AS events FROM (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events) GROUP BY user_id",
    "node_notes": _W + ", l AS (SELECT source, string_agg('- ' || kind || ' [[' || name || ']]', chr(10) ORDER BY r) FILTER (r <= 80) AS links, count(*) AS n FROM (SELECT e.source, e.kind, n.name, row_number() OVER (PARTITION BY e.source ORDER BY e.kind, n.name) AS r FROM edges e JOIN nodes n ON n.node_id = e.target) GROUP BY source) SELECT node_id, '# ' || name || chr(10) || 'kind: ' || kind || chr(10) || 'file: ' || coalesce(file_path, 'n/a') || chr(10) || CASE WHEN links IS NOT NULL THEN '## Links' || chr(10) || links || CASE WHEN n > 80 THEN chr(10) || '- … ' || (n - 80) || ' more' ELSE '' END || chr(10) ELSE '' END AS note FROM nodes LEFT JOIN l ON l.source = node_id",
}
