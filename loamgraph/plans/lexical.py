from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layers as L
from ..functions import routes as Ro
from ..functions import text as T
from ..functions import vocabulary as V
from ..session import table
from ..sources import relations as R
from .catalog import _W, LANG_SQL

j = lambda c: F.array_join(c, " ")
_arr = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_TOK = "[x FOR x IN regexp_split_to_array(lower({c}), '[^a-z0-9]+') IF len(x) > {n}]"


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def _names(s, d):
    return R.nodes(s, d).select("node_id", "name", "kind", "stable_id", F.coalesce("file_path", F.lit("")).alias("path"))


#: Routes as they are written, and as they are compared (fixed by what a route is; null: none).
WRITTEN = [
    ("/API/Users/:id", "/api/users/*"), ("/users/{id}/posts?x=1", "/users/*/posts"), ("/a/[slug]#top", "/a/*"), ("/static/app.js", None), ("//cdn/x", None), ("/api/x.json", None), ("/lib/x.cjs", None),
    ("/:a/:b", None), ("users", None), ("/a b", None), ("/v1/../x", None), ("/items/${id}/", "/items/*"), ("/clip.mp4", "/clip.mp4"), ("/", None),
]
#: Two compared routes, and whether they are one.
COMPARED = [
    ("/api/users/*", "/api/users/42", True), ("/users", "/users", True), ("/abc", "/abc", False), ("/users/list", "/api/users/list", True), ("/list", "/api/list", False), ("/a/*", "/*/b", False), ("/api/*/x", "/api/y/x", True), ("/api/a", "/api/b", False),
]
#: A text, the routes it registers and those it calls.
CODE = [
    ("app.get('/users', f); router.post(\"orders\", g)", "/orders /users", "/users"), ("fetch(`/api/x`); axios.get( '/y' ); fetch('z')", "", "/api/x /y"), ("@Controller('cats')", "/cats", ""), ("APP.GET('/Up')", "/Up", "/Up"), ("let s = '/no';", "", ""),
]


QUERIES = {
    "search_tokens": lambda s, d: _names(s, d).select("node_id", j(T.search_tokens(F.col("stable_id"))).alias("tokens")),
    "literal_terms": lambda s, d: _names(s, d).select("node_id", j(T.literal_terms(F.col("name"))).alias("terms")),
    "router_tokens": lambda s, d: _docs(s, d).select("doc_id", j(T.router_tokens(F.col("text"))).alias("tokens")),
    "lexical_tokens": lambda s, d: _docs(s, d).select("doc_id", j(T.lexical_tokens(F.col("text"))).alias("tokens")),
    "label_match": lambda s, d: R.communities(s, d).filter(T.label_matches(F.col("label"), T.words("report", "servic", "lib"))).select("community_id", "label"),
    "lexical_count": lambda s, d: R.nodes(s, d).select("node_id", T.lexical_count(T.words("cursor", "ledger", "src"), F.lower("name"), F.lower(F.coalesce("file_path", F.lit("")))).alias("n")),
    "slugs": lambda s, d: _names(s, d).select("node_id", T.slug(F.col("stable_id")).alias("slug")),
    "truncate": lambda s, d: _docs(s, d).select("doc_id", T.truncated(F.col("text"), 100).alias("text")),
    "short_symbol": lambda s, d: _names(s, d).select("node_id", T.short_symbol(F.col("path")).alias("short")),
    "change_kind": lambda s, d: _docs(s, d).select("doc_id", T.change_kind(F.col("text")).alias("kind")),
    "line_ranges": lambda s, d: R.nodes(s, d).select("node_id", T.line_range(F.col("line_start"), F.col("line_end")).alias("lines")),
    "layer_words": lambda s, d: _names(s, d).select("node_id", F.explode(F.array_distinct(F.split("path", "/"))).alias("word")).select("node_id", "word", L.of_word(F.col("word")).alias("layer")).filter("layer is not null"),
    "uuid5_ids": lambda s, d: R.nodes(s, d).select("node_id", T.uuid5(F.concat_ws(":", "repo_id", "stable_id")).alias("id")),
    "content_hashes": lambda s, d: R.chunks(s, d).select("chunk_id", T.sha256(F.col("content")).alias("h"), (F.col("content_hash") == T.sha256(F.col("content"))).alias("same")),
    "construct_services": lambda s, d: _names(s, d).filter("kind = 'struct'").select("node_id", T.construct_service(F.col("name")).alias("service")),
    "test_symbols": lambda s, d: R.nodes(s, d).select("node_id", T.is_test_symbol(F.col("name")).alias("is_test")),
    "like_escape": lambda s, d: _names(s, d).select("node_id", T.like_escaped(F.col("name")).alias("pattern")),
    "languages": lambda s, d: R.files(s, d).select("file_id", T.language_of(F.col("path")).alias("language")),
    "import_packages": lambda s, d: R.files(s, d).filter(F.col("path").rlike(r"\.(ts|js|mts|mjs|jsx)$")).select("file_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"from '([^']+)'"), F.lit(1)))).alias("module")).select("file_id", "module", T.import_package(F.col("module")).alias("package"), T.is_bare(F.col("module")).alias("bare")),
    "route_extract": lambda s, d: s.createDataFrame([(c,) for c, _, _ in CODE], "content string").select("content", j(Ro.registered(F.col("content"))).alias("registered"), j(Ro.called(F.col("content"))).alias("called")),
    "route_normalize": lambda s, d: s.createDataFrame([(r,) for r, _ in WRITTEN], "raw string").select("raw", Ro.normalized(F.col("raw")).alias("route")),
    "route_match": lambda s, d: s.createDataFrame([x[:2] for x in COMPARED], "a string, b string").select("a", "b", Ro.match(F.col("a"), F.col("b")).alias("same")),
    "symbol_reference": lambda s, d: R.call_names(s, d).join(R.nodes(s, d).filter("kind in ('function', 'method')").select("node_id", "repo_id", F.col("name").alias("own")), ["node_id", "repo_id"]).filter("callee <> own").groupBy("repo_id", "callee").agg(F.countDistinct("node_id").alias("users")),
}

_N = _W + ", nm AS (SELECT node_id, name, kind, stable_id, coalesce(file_path, '') AS path FROM nodes) "
_ASCII = "regexp_replace(text, '[^\\x00-\\x7f]', ' ', 'g')"
_text = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
_rows = lambda rows, names: "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows) + f") t({names})"
_cases = lambda table_, c: "CASE " + " ".join(f"WHEN {c} IN ({', '.join(repr(x) for x in names)}) THEN '{k}'" for k, names in table_.items()) + " END"
_svc = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(name), '{m}')" for m in marks) + f" THEN '{k}'" for k, marks in V.CONSTRUCT_SERVICES) + " ELSE 'aws' END"
SQL = {
    "search_tokens": _N + f"SELECT node_id, array_to_string({_TOK.format(c='stable_id', n=1)}, ' ') AS tokens FROM nm",
    "literal_terms": _N + f"SELECT node_id, array_to_string(list_sort(list_distinct([x FOR x IN {_TOK.format(c='name', n=2)} IF NOT list_contains({_arr(V.LITERAL_STOP)}, x)] || CASE WHEN len(regexp_replace(lower(name), '[^a-z0-9]', '', 'g')) > 4 THEN [regexp_replace(lower(name), '[^a-z0-9]', '', 'g')] ELSE [] END)), ' ') AS terms FROM nm",
    "lexical_count": _N + "SELECT node_id, CAST(list_sum([contains(lower(name), t)::INT + contains(lower(path), t)::INT FOR t IN ['cursor', 'ledger', 'src']]) AS INT) AS n FROM nm",
    "label_match": _W + "SELECT community_id, label FROM comms WHERE list_bool_or([s = 'report' OR s = 'lib' OR starts_with(s, 'report') OR starts_with(s, 'servic') FOR s IN regexp_split_to_array(lower(label), '[^a-z0-9]+')])",
    "slugs": _N + "SELECT node_id, CASE WHEN g = '' THEN 'item' ELSE g END AS slug FROM (SELECT node_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(stable_id), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '-+$', '') AS g FROM nm)",
    "truncate": "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '… [+' || (length(text) - 100) || ' chars in the indexed chunk]' ELSE text END AS text FROM documents",
    "short_symbol": _N + "SELECT node_id, CASE WHEN len(string_split(path, '/')) > 2 THEN '…/' || array_to_string(string_split(path, '/')[-2:], '/') ELSE path END AS short FROM nm",
    "line_ranges": _W + "SELECT node_id, CASE WHEN line_start IS NULL THEN 'n/a' WHEN line_end IS NULL OR line_end = line_start THEN line_start::VARCHAR ELSE line_start || '-' || line_end END AS lines FROM nodes",
    "layer_words": _N + f"SELECT node_id, w AS word, {_cases(V.WORD_LAYERS, chr(119))} AS layer FROM (SELECT DISTINCT node_id, unnest(string_split(path, '/')) AS w FROM nm) WHERE layer IS NOT NULL",
    "content_hashes": _W + "SELECT chunk_id, sha256(content) AS h, content_hash = sha256(content) AS same FROM chks",
    "construct_services": _N + f"SELECT node_id, {_svc} AS service FROM nm WHERE kind = 'struct'",
    "test_symbols": _W + "SELECT node_id, (lower(name) LIKE 'test%' OR lower(name) LIKE '%test' OR lower(name) LIKE 'spec%' OR lower(name) LIKE '%spec') AS is_test FROM nodes",
    "like_escape": _N + r"SELECT node_id, regexp_replace(name, '([\\%_])', '\\\1', 'g') AS pattern FROM nm",
    "languages": _W + f"SELECT file_id, {LANG_SQL.format(p='path')} AS language FROM files",
    "import_packages": _W + r"SELECT file_id, module, regexp_extract(module, '^(@[^/]+/[^/]+|[^/@][^/]*)', 1) AS package, NOT regexp_matches(module, '^(\.|/|~/|@/)') AS bare FROM (SELECT DISTINCT file_id, unnest(regexp_extract_all(content, 'from ''([^'']+)''', 1)) AS module FROM files WHERE regexp_matches(path, '\.(ts|js|mts|mjs|jsx)$'))",
    "symbol_reference": _W + "SELECT c.repo_id, callee, count(DISTINCT c.node_id) AS users FROM callnames c JOIN nodes n ON n.node_id = c.node_id AND n.repo_id = c.repo_id WHERE n.kind IN ('function', 'method') AND callee <> n.name GROUP BY ALL",
    "uuid5_ids": _W + f", h AS (SELECT node_id, sha1(from_hex('{V.ID_NAMESPACE.replace('-', '')}') || encode(repo_id || ':' || stable_id)) AS h FROM nodes) SELECT node_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || (['8', '9', 'a', 'b'])[('0x' || substr(h, 17, 1))::INT % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h",
    "router_tokens": f"SELECT doc_id, array_to_string(list_sort(list_distinct([x FOR x IN {_TOK.format(c=_ASCII, n=2)} IF NOT list_contains({_arr(V.LITERAL_STOP + V.ROUTE_STOP)}, x)])), ' ') AS tokens FROM documents",
    "lexical_tokens": f"SELECT doc_id, array_to_string(list_sort(list_distinct([x FOR x IN {_TOK.format(c=_ASCII, n=2)} IF NOT list_contains({_arr(V.LEXICAL_STOP)}, x)])), ' ') AS tokens FROM documents",
    "change_kind": f"SELECT doc_id, CASE WHEN len([x FOR x IN {_TOK.format(c=_ASCII, n=0)} IF {' OR '.join(f'starts_with(x, {w!r})' for w in V.BUG_WORDS)}]) > 0 THEN 'bug' ELSE 'feature' END AS kind FROM documents",
    "route_extract": _rows(CODE, "content, registered, called"),
    "route_normalize": _rows(WRITTEN, "raw, route"),
    "route_match": _rows(COMPARED, "a, b, same"),
}
