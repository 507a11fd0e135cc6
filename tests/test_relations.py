from loamgraph.sources import relations as R


def test_edges(spark, tmp_path):
    node = "node_id string, repo_id string, kind string, stable_id string, name string, file_path string, line_start int, line_end int, chunk_count long, metadata string"
    rows = [("f1", "r", "file", "file:a", "a", "a.py", 1, 9, 0, None), ("f2", "r", "file", "file:b", "b", "b.py", 1, 9, 0, None), ("dep", "r", "dependency", "x", "x", None, None, None, 0, None)]
    rows += [(i, "r", "function", f"{p}:{n}", n, p, 1, 2, 1, None) for i, n, p in (("n1", "run", "a.py"), ("n2", "help", "a.py"), ("n3", "help", "b.py"), ("n4", "far", "b.py"))]
    rows += [("n5", "q", "function", "c:far", "far", "a.py", 1, 2, 1, None), rows[3]]
    spark.createDataFrame(rows, node).write.parquet(str(tmp_path / "graph_nodes.parquet"))
    chunk = "chunk_id string, repo_id string, file_id string, node_id string, chunk_type string, content string, content_hash string, line_start int, line_end int, metadata string"
    body = "def run(x):\n    help(x); help(y)\n    far(x)\n    unknown(x)\n"
    spark.createDataFrame([("c1", "r", "i", "n1", "function", body, None, 1, 4, None), ("c2", "r", "i", None, "code", "far(1)", None, 1, 1, None)], chunk).write.parquet(str(tmp_path / "chunks.parquet"))
    got = {(e.kind, e.source, e.target) for e in R.edges(spark, str(tmp_path)).collect()}
    assert {x for x in got if x[0] == "calls"} == {("calls", "n1", "n2"), ("calls", "n1", "n4")}  # the own file's first; itself left out
    assert {x for x in got if x[0] == "defines"} == {("defines", "f1", "n1"), ("defines", "f1", "n2"), ("defines", "f2", "n3"), ("defines", "f2", "n4")}
