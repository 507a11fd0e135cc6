import itertools
import uuid

from pyspark.sql import functions as F

from loamgraph.functions import layers, routes, text, vocabulary
from loamgraph.operators import graph, merkle, search, summary, vector
from loamgraph.sources import extract, files
from loamgraph.sinks import notes
from loamgraph.streaming import feeds


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_text(spark):
    assert one(spark, text.search_tokens(F.lit("How does OCL-work? a b1 Ä"))) == ["how", "does", "ocl", "work", "b1"]
    assert one(spark, text.truncated(F.lit("abcdef"), 4)) == "abcd… [+2 chars in the indexed chunk]"
    assert one(spark, text.uuid5(F.lit("a:b"))) == str(uuid.uuid5(uuid.UUID(vocabulary.ID_NAMESPACE), "a:b"))
    assert one(spark, text.change_kind(F.lit("Hotfixes the door"))) == "bug"
    assert one(spark, text.label_matches(F.lit("onchainlabs/ocl-repository.ts"), text.words("ocl"))) is True
    assert one(spark, text.label_matches(F.lit("author/x"), text.words("auth"))) is False
    assert one(spark, text.label_matches(F.lit("onchainlabs"), text.words("onchain"))) is True


def test_layers(spark):
    cases = {("src/services/a.rs", "function"): "core", ("api/x.ts", "file"): "interface", ("app/x.ts", "file"): "entry", ("x/y.sol", "file"): "foundation", ("", "file"): "unknown", ("", "deployment_resource"): "foundation", ("lib/x.py", "file"): "unknown"}
    for (p, k), want in cases.items():
        assert one(spark, layers.of_path(F.lit(p), F.lit(k))) == want


def test_routes(spark):
    norm = lambda x: one(spark, routes.normalized(F.lit(x)))
    assert norm("/api/Users/:id?x=1") == "/api/users/*"
    assert norm("/a/${b}/c") == "/a/*/c"
    assert norm("/x.png") is None and norm("//cdn") is None and norm("/:id") is None and norm("users") is None
    match = lambda a, b: one(spark, routes.match(F.lit(a), F.lit(b)))
    assert match("/api/users/*", "/api/users/42") and match("/users/list", "/api/users/list")
    assert not match("/list", "/api/list") and not match("/*/x", "/y/*") and match("/users", "/users") and not match("/abc", "/abc")
    src = "app.get('/api/users/:id', f); router.post(\"api/projects\")"
    assert one(spark, routes.registered(F.lit(src))) == ["/api/projects", "/api/users/:id"]
    assert one(spark, routes.called(F.lit("await fetch(`/api/users/${id}`)"))) == ["/api/users/${id}"]


def _edges(spark, pairs, kind="calls", cost=0.1, conf=1.0):
    return spark.createDataFrame([("r", a, b, kind, cost, conf) for a, b in pairs], "repo_id string, source string, target string, kind string, cost double, confidence double")


def test_louvain_cliques(spark):
    pairs = [(f"c{c}_{i}", f"c{c}_{j}") for c in range(3) for i, j in itertools.combinations(range(4), 2)]
    nodes = spark.createDataFrame([(f"c{c}_{i}", f"c{c}_{i}") for c in range(3) for i in range(4)], "node_id string, stable_id string")
    w = graph.pair_weights(_edges(spark, pairs))
    got = graph.louvain(w, nodes).collect()
    sizes = sorted(len([r for r in got if r.label == x]) for x in {r.label for r in got})
    assert sizes == [4, 4, 4]
    again = graph.louvain(w.repartition(7), nodes).collect()
    assert sorted(got) == sorted(again)
    q = graph.modularity(w, spark.createDataFrame([(r.node_id, r.label) for r in got], "node_id string, label string")).first().modularity
    assert abs(q - 2 / 3) < 1e-6


def test_quotient(spark):
    tri = lambda p: list(itertools.combinations([f"{p}{i}" for i in range(3)], 2))
    e = _edges(spark, tri("a") + tri("b")).unionByName(_edges(spark, [("a0", "b0"), ("b1", "a1")], cost=0.35, conf=0.7)).unionByName(_edges(spark, [("a2", "b2")], "depends_on", 0.2, 1.0))
    m = spark.createDataFrame([(f"{p}{i}", p) for p in "ab" for i in range(3)], "node_id string, community_id string")
    r = graph.quotient(e, m).collect()
    assert [(x.a, x.b, x.links, x.kind) for x in r] == [("a", "b", 3, "calls")]


def test_order_and_paths(spark):
    items = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("p", "c", 3)], "plan string, item string, priority int")
    links = [("p", "a", "b"), ("p", "a", "b"), ("p", "b", "c")]
    order = lambda x: {r.item: r.place for r in graph.reading_order(items, spark.createDataFrame(x, "plan string, item string, needs string")).collect()}
    assert order(links) == {"c": 1, "b": 2, "a": 3}
    assert sorted(order([*links, ("p", "c", "b")]).values()) == [1, 2, 3]
    assert order([("p", "z", "y")]) == {"a": 1, "b": 2, "c": 3}
    e = _edges(spark, [("a", "b"), ("b", "c")], cost=0.5)
    s = spark.createDataFrame([("a",), ("c",)], "node_id string")
    assert {(r.start, r.end, r.cost) for r in graph.cheapest_paths(e, s, 3).collect()} == {("a", "c", 1.0), ("c", "a", 1.3)}


def test_merkle(spark):
    f = spark.createDataFrame([("r", "f1", "a"), ("r", "f2", "b")], "repo_id string, file_id string, path string")
    c = spark.createDataFrame([("f1", 1, 2, "function", "h1"), ("f1", 3, 4, "function", "h2")], "file_id string, line_start int, line_end int, chunk_type string, content_hash string")
    h = {r.file_id: r.hash for r in merkle.file_hashes(f, c).collect()}
    swapped = c.withColumn("line_start", 5 - F.col("line_start"))
    assert h["f2"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert {r.file_id: r.hash for r in merkle.file_hashes(f, swapped).collect()}["f1"] != h["f1"]


def test_retained_documents(spark):
    rows = [("q", f"c{i:02d}", 1.0 - i / 100, i == 8) for i in range(10)]
    df = spark.createDataFrame(rows, "question string, chunk_id string, score double, supplemental boolean")
    got = [r.chunk_id for r in search.retained_documents(df, 5).orderBy("place").collect()]
    assert got == ["c00", "c01", "c02", "c03", "c08"]


def test_suppression_and_expansions(spark):
    df = spark.createDataFrame([("q", "a", '{"dependency": "x"}'), ("q", "b", None), ("p", "c", '{"dependency": "x"}')], "question string, chunk_id string, metadata string")
    assert {r.chunk_id for r in search.suppressed_dependencies(df, False).collect()} == {"b", "c"}
    assert search.suppressed_dependencies(df, True).count() == 3
    assert len(one(spark, search.expansions(F.lit("two-factor")))) == 5 and len(one(spark, search.expansions(F.lit("login")))) == 4


def test_vector(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, 1.0])], "k string, embedding array<float>")
    assert [(r.k, r.score) for r in vector.top_k(df, "k", [2.0, 0.0], 3).collect()] == [("a", 1.0), ("c", 0.707107), ("b", 0.0)]


def test_extraction(spark):
    py = "import os\nfrom . import x\n@d\nasync def f(a):\n    g(a)\nclass C:\n    def m(self): pass\n"
    rs = "use a::b;\n// fn no() {}\npub fn yes(x: &str) -> u8 { call(x) }\nstruct S { a: u8 }\n"
    js = "import z from './z';\nexport const h = async (a) => { k(a); };\nclass D {}\ninterface I {}\n"
    rows = extract.records(spark.createDataFrame([("r", "a.py", py), ("r", "b.rs", rs), ("r", "c.ts", js), ("r", "bad.py", "def ("), ("r", "n.py", None)], "repo_id string, path string, content string")).collect()
    names = {(r.path, r.record, r.name) for r in rows}
    assert {("a.py", "symbol", "f"), ("a.py", "symbol", "C"), ("a.py", "symbol", "m"), ("a.py", "import", "os"), ("a.py", "call", "g"), ("b.rs", "symbol", "yes"), ("b.rs", "symbol", "S"), ("b.rs", "import", "a::b"), ("b.rs", "call", "call"), ("c.ts", "symbol", "h"), ("c.ts", "symbol", "D"), ("c.ts", "import", "./z")} <= names
    assert ("b.rs", "symbol", "no") not in names and not any(r.path == "bad.py" for r in rows)
    assert extract.manifest_dependencies("x/package.json", '{"dependencies": {"react": "1"}, "devDependencies": {"tsc": "2"}}') == [("npm", "dependencies", "react", "1"), ("npm", "devDependencies", "tsc", "2")]
    assert extract.manifest_dependencies("Cargo.toml", '[dependencies]\nserde = { version = "1" }') == [("cargo", "dependencies", "serde", "1")]
    assert extract.manifest_dependencies("Cargo.toml", "[[[") == []


def test_split_chunks():
    text_ = "\n".join("ä" * 90 for _ in range(40)) + "\n" + "x" * 5000
    parts = extract.parts_of(text_)
    assert all(len(p.encode()) <= 2000 for p in parts) and "".join(parts).replace("\n", "") == text_.replace("\n", "")


def test_tree_pages_and_notes(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "node_modules" / "b.js").write_text("1")
    (tmp_path / "src" / "c.bin").write_text("1")
    got = files.source_tree(spark, str(tmp_path), "r").collect()
    assert [(r.path, r.language) for r in got] == [("src/a.py", "python")]
    html = notes.page("T", spark.createDataFrame([("</script>", 1)], "a string, b int"))
    (tmp_path / "p.html").write_text(html.replace("report-data", "stack-data"))
    p = files.pages(spark, str(tmp_path)).collect()
    assert [(r.kind, r.title) for r in p] == [("stack", "T")] and "</script>1" not in html
    notes.write_notes(spark.createDataFrame([("ab1", "# n")], "node_id string, note string"), "node_id", str(tmp_path / "notes"))
    assert spark.read.text(str(tmp_path / "notes")).filter("value = '# n'").count() == 1


def test_streams(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    (tmp_path / "in").mkdir()
    events.repartition(3).write.parquet(str(tmp_path / "in" / "x"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in" / "x"))
    q = feeds.once(stream, ["event_id"]).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == events.count()
    from loamgraph.operators.versioned import VersionedTable

    t = VersionedTable(spark, str(tmp_path / "table"), ["event_id"], 2)
    feeds.upkeep(stream, t, str(tmp_path / "cp")).awaitTermination(240)
    assert t.snapshot().count() == events.count()


def test_summary_cap(spark):
    rows = spark.createDataFrame([("c", "a-b", 2, [("f", "function", "x.rs"), ("x.rs", "file", "x.rs")], ["s" * 900] * 5)], "community_id string, label string, member_count long, members array<struct<name string, kind string, path string>>, snippets array<string>")
    roles = spark.createDataFrame([("c", "core")], "community_id string, layer string")
    s = summary.composed(rows, roles).first().summary
    assert s.startswith("a-b (a b)\nRole: core logic.\nKey symbols: f.\nFiles: x.rs.\nComposition: 1 file, 1 function (2 members).\nRepresentative code:\n") and len(s) <= 1600
