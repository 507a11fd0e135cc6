"""The commands on the fixture tree: index, search, change one file, index again."""

import pytest
from pyspark.sql import functions as F

from loamgraph import commands as C
from loamgraph.operators import retrieval as Q
from loamgraph.operators import writes as W
from loamgraph.operators.embedding import Embedder, WordHashes, checked
from loamgraph.plans import fixture as X
from loamgraph.session import scratch
from loamgraph.store import GraphStore


EMBEDDER = WordHashes(32)


@pytest.fixture(scope="module")
def repos(spark):
    r = X.repositories(spark)
    return r.withColumns({"remote_url": F.lit(None).cast("string"), "current_commit_sha": F.lit("c1"), "created_at": F.lit("2025-01-01").cast("timestamp"), "updated_at": F.lit("2025-01-01").cast("timestamp")})


@pytest.fixture(scope="module")
def store(spark, repos):
    s = GraphStore(spark, scratch(spark, "store"), 2)
    s.first = C.analyze(s, X.files(spark, X.TREE), repos, EMBEDDER)
    return s


def test_analyze(spark, store, repos):
    assert {r.relation: r.n for r in C.stats(store).collect()}["files"] == len(X.TREE)
    assert store.first["embedded"] == store.read("chunks").count() and store.first["pending"] == store.read("communities").count() > 2
    log = [r.status for r in store.read("runs").orderBy("finished_at").collect()]
    assert sorted(log) == ["completed", "running"]
    assert store.read("communities").filter("summary is null or summary_hash is null").count() == 0
    kinds = {r.kind for r in store.read("nodes").join(store.read("members"), "node_id").select("kind").distinct().collect()}
    assert "repository" not in kinds
    before = store.versions()
    again = C.analyze(store, X.files(spark, X.TREE), repos, EMBEDDER)
    assert again == {"embedded": 0, "skipped": store.first["pending"], "reused": 0, "pending": 0}
    after = store.versions()
    assert {n for n in after if after[n] != before[n]} <= {"runs"}  # nothing else is written


def test_query_finds_and_explains(store):
    hits = C.query(store, "where is a load from the store run", EMBEDDER, 6).collect()
    assert [r.place for r in hits] == list(range(1, len(hits) + 1)) and any(r.path == "app/main.py" for r in hits)
    assert all(set(r.retrieved_by.split(",")) <= {"semantic", "keyword", "literal"} for r in hits)
    routed = C.query(store, "where is a load from the store run", EMBEDDER, 6, hierarchical=True)
    assert {r.mode for r in routed.collect()} <= {"hierarchical", "flat-fallback"}
    paths = C.paths(store, C.query(store, "run load", EMBEDDER, 6)).collect()
    assert paths == sorted(paths, key=lambda r: r.total_cost) and all(r.nodes[0] == r.start and r.nodes[-1] == r.end for r in paths)
    assert C.feature_context(store, "pay with the vault", EMBEDDER, 5).count() == 5
    assert C.impact(store, "pay with the vault", EMBEDDER).filter("path = 'contracts/Vault.sol'").count() == 1
    assert C.stack(store).filter("section = 'package'").count() == 5


def test_routes_fall_back_to_labels(store):
    g = C.searchable(store, EMBEDDER)
    far = [0.0] * 31 + [1.0]
    some = {**g, "community_vectors": g["community_vectors"].limit(0)}
    labels = [r.label for r in g["communities"].collect()]
    by_label = Q.routes(some, " ".join(labels), far).collect()
    assert 0 < len(by_label) <= 5 and {r.how for r in by_label} == {"label"}
    sizes = [r.member_count for r in by_label]
    assert sizes == sorted(sizes, reverse=True)
    assert Q.routes(some, "zzz qqq", far).count() == 0
    assert {r.how for r in Q.routes(g, " ".join(labels), EMBEDDER.embed_batch([" ".join(labels)])[0]).collect()} == {"summary"}


def test_context_paths_against_brute_force(spark):
    import heapq
    import random

    rng = random.Random(3)
    edges = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}", rng.choice([0.1, 0.2, 0.35, 0.55])) for _ in range(60)]
    hits = [(f"n{i}", i + 1) for i in range(6)]
    near = [e for e in edges if e[0] in dict(hits) or e[1] in dict(hits)]
    arcs = {}
    for a, b, c in near:
        for x, y, w in ((a, b, c), (b, a, c + 0.15)):
            arcs.setdefault(x, {})[y] = min(w, arcs.get(x, {}).get(y, 9))
    want = {}
    for s, _ in hits:
        dist, todo = {s: 0.0}, [(0.0, s)]
        while todo:
            d, x = heapq.heappop(todo)
            for y, w in arcs.get(x, {}).items():
                if x != y and d + w < dist.get(y, 99) - 1e-12:
                    dist[y] = d + w
                    heapq.heappush(todo, (d + w, y))
        want.update({(s, t): round(dist[t], 6) for t, _ in hits if t in dist and t > s})
    df = spark.createDataFrame(edges, "source string, target string, cost double")
    got = Q.context_paths(df, spark.createDataFrame(hits, "node_id string, place int"), 100).collect()
    assert {(r.start, r.end): r.total_cost for r in got} == pytest.approx(want)
    for r in got:
        assert sum(arcs[a][b] for a, b in zip(r.nodes, r.nodes[1:])) == pytest.approx(r.total_cost)


def test_add_changes_what_changed(spark, store, repos):
    tree = [x for x in X.TREE if x[0] not in dict(X.EDITED)] + X.EDITED
    old = {r.chunk_id for r in store.read("chunks").filter("file_path not in ('app/store.py')").select("chunk_id").collect()}
    paths = spark.createDataFrame([(X.REPOSITORY, p) for p, _ in X.EDITED], "repo_id string, path string")
    blast = C.add(store, X.files(spark, tree), repos, paths, EMBEDDER)
    assert blast.count() >= 1
    now = {r.chunk_id for r in store.read("chunks").select("chunk_id").collect()}
    assert old <= now
    assert store.read("nodes").filter("name = 'save'").count() == 1
    assert store.read("chunks").join(store.read("embeddings"), "chunk_id", "left_anti").count() == 0


def test_failures_leave_everything(spark, store, repos):
    before = {n: v for n, v in store.versions().items() if n not in ("runs",)}
    more = X.files(spark, [*X.TREE, ("x.py", "def brand_new(q):\n    return q * 7\n")])
    broken = WordHashes(32)
    broken.embed_batch = None
    with pytest.raises(Exception, match="callable"):
        C.analyze(store, more, repos, broken)
    assert store.versions()["embeddings"] >= before["embeddings"]
    assert "failed" in {r.status for r in store.read("runs").collect()}
    assert store.read("embeddings").filter("embedding is null").count() == 0


def test_projects_and_clean(spark, store):
    store.write({"projects": spark.createDataFrame([("p", "one")], "project_id string, name string"), "project_members": spark.createDataFrame([("p", X.REPOSITORY, "ledger", None)], "project_id string, repo_id string, alias string, linked_hash string")})
    none = spark.createDataFrame([], "kind string, name string, from_repo string, from_path string, to_repo string, to_path string")
    repo = X.repositories(spark)
    assert C.link_projects_of(store, repo, none) == {"p": "linked"}
    assert C.link_projects_of(store, repo, none) == {"p": "up to date"}
    store.clean(repo)
    assert store.read("nodes").count() == store.read("embeddings").filter("model_id = 'word-hashes'").count() == 0 and store.read("projects").count() == 1
    store.clean()
    assert store.read("projects").count() == 0


def test_vectors_are_checked(spark):
    class Short(WordHashes):
        def embed_batch(self, texts):
            return super().embed_batch(texts)[:-1]

    with pytest.raises(ValueError, match="1 vectors for 2 texts"):
        checked(Short(8), ["a", "b"])
    wrong = WordHashes(8)
    assert isinstance(wrong, Embedder) and checked(wrong, []) == []
    vectors = wrong.embed_batch(["a"])
    wrong.embed_batch = lambda texts: [[float("nan")] * 8 for _ in texts]
    with pytest.raises(ValueError, match="not finite"):
        checked(wrong, ["a"])
    rows = spark.createDataFrame([("e", "c", "p", "m", 8, "h", vectors[0][:4])], "embedding_id string, chunk_id string, provider string, model_id string, dimensions int, content_hash string, embedding array<float>")
    with pytest.raises(Exception, match="another size"):
        W.insert_embeddings(rows.limit(0), rows).collect()
    assert wrong.dimensions == 8 and len(WordHashes(4).embed_batch(["", "!"])[0]) == 4
