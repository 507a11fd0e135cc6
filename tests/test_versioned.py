import pytest

from loamgraph.operators.incremental import pending_chunks
from loamgraph.operators.versioned import CommitConflict, VersionedTable, run_incremental
from loamgraph.session import scratch


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def table(spark):
    return VersionedTable(spark, scratch(spark, "vt"), ["k"], 3)


def test_changes_between_versions(spark, table):
    a = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("c", 3)], "k string, v int")
    b = spark.createDataFrame([("a", 1), ("b", 9), ("d", 4), ("c", 3)], "k string, v int")
    v0, v1 = table.overwrite(a), table.overwrite(b)
    assert rows(table.snapshot(v0)) == [("a", 1), ("b", 2), ("c", 3), ("c", 3)]
    assert rows(table.changes(v0, v1)) == [("b", 2, "delete", 1), ("b", 9, "insert", 1), ("c", 3, "delete", 1), ("d", 4, "insert", 1)]
    assert rows(table.changes(-1, v0)) == [("a", 1, "insert", 1), ("b", 2, "insert", 1), ("c", 3, "insert", 2)]
    assert table.changes(v1, v1).count() == 0


def test_deletion_vectors(spark, table):
    v0 = table.overwrite(spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int"))
    v1 = table.delete(spark.createDataFrame([("b",), (None,)], "k string"))
    assert rows(table.snapshot(v1)) == [("a", 1)]
    assert sorted(map(str, rows(table.changes(v0, v1)) if False else table.changes(v0, v1).select("v").collect())) == ["Row(v=2)", "Row(v=3)"]
    v2 = table.append(spark.createDataFrame([("e", 5)], "k string, v int"))
    v3 = table.delete(spark.createDataFrame([("a",)], "k string"))
    assert rows(table.snapshot(v3)) == [("e", 5)]
    assert rows(table.changes(v1, v2)) == [("e", 5, "insert", 1)]
    assert rows(table.changes(v2, v3)) == [("a", 1, "delete", 1)]
    assert rows(table.changes(v0, v3).select("v", "_vt_change")) == [(1, "delete"), (2, "delete"), (3, "delete"), (5, "insert")]


def test_empty_and_conflict(spark, table):
    v0 = table.overwrite(spark.createDataFrame([], "k string, v int"))
    assert table.snapshot(v0).count() == 0
    with pytest.raises(CommitConflict):
        table._commit(v0, "x", {})


def test_incremental_run_neither_skips_nor_repeats(spark, table):
    out = VersionedTable(spark, scratch(spark, "vt-out"), ["k"], 3)
    seen = []

    def work(df):
        seen.append(sorted(r.k for r in df.collect()))
        if boom:
            raise RuntimeError("lost")
        return df

    boom = False
    table.overwrite(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"))
    assert run_incremental(table, out, work) == 0
    assert run_incremental(table, out, work) is None
    table.append(spark.createDataFrame([("c", 3)], "k string, v int"))
    boom = True
    with pytest.raises(RuntimeError):
        run_incremental(table, out, work)
    boom = False
    run_incremental(table, out, work)
    table.delete(spark.createDataFrame([("a",)], "k string"))
    run_incremental(table, out, work)
    assert seen == [["a", "b"], ["c"], ["c"], []]
    assert rows(out.snapshot()) == [("b", 2), ("c", 3)]


def test_pending_chunks(spark):
    ts = "2025-01-0%d 00:00:00"
    chunks = spark.createDataFrame(
        [("same", "x", "AA"), ("same", "x", "AA"), ("changed", "x", "bb"), ("new", "x", "cc"), ("nullhash", "abc", None), ("failed", "x", "dd"), ("late", "x", "ee"), (None, "x", "ff")],
        "chunk_id string, content string, content_hash string",
    ).withColumnRenamed("content", "content")
    abc = "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD"
    runs = spark.createDataFrame([("r1", "running"), ("r1", "failed"), ("r1", "completed"), ("r2", "failed")], "run_id string, status string")
    log = spark.createDataFrame(
        [("r1", "same", "aa", ts % 1), ("r1", "changed", "b0", ts % 1), ("r1", "nullhash", abc, ts % 1), ("r2", "failed", "dd", ts % 1), ("r1", "late", "e0", ts % 1), ("r1", "late", "EE", ts % 2), ("r9", "new", "cc", ts % 1), ("r1", "gone", "zz", ts % 1)],
        "run_id string, chunk_id string, content_hash string, written_at string",
    )
    assert rows(pending_chunks(chunks, log, runs)) == [("changed",), ("failed",), ("new",)]
    empty = log.limit(0)
    assert len(rows(pending_chunks(chunks, empty, runs))) == 6
    assert rows(pending_chunks(chunks.limit(0), log, runs)) == []


def test_rows_added_again_after_a_delete(spark, table):
    d = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    v0 = table.overwrite(d)
    v1 = table.delete(d.select("k"))
    v2 = table.append(d)
    assert rows(table.changes(v1, v2)) == [("a", 1, "insert", 1), ("b", 2, "insert", 1), ("c", 3, "insert", 1)]
    assert table.changes(v0, v2).count() == 0
    assert rows(table.snapshot()) == [("a", 1), ("b", 2), ("c", 3)]


def test_a_failed_read_back_is_no_empty_table(spark, table, monkeypatch):
    table.overwrite(spark.createDataFrame([("a", 1)], "k string, v int"))
    monkeypatch.setattr(VersionedTable, "_digest", staticmethod(lambda columns: (_ for _ in ()).throw(OSError("store is away"))))
    with pytest.raises(OSError):
        table.overwrite(spark.createDataFrame([("b", 2)], "k string, v int"))
    monkeypatch.undo()
    assert rows(table.snapshot()) == [("a", 1)]


def test_a_crash_between_data_and_commit(spark, table, monkeypatch):
    table.overwrite(spark.createDataFrame([("a", 1)], "k string, v int"))
    monkeypatch.setattr(VersionedTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.append(spark.createDataFrame([("b", 2)], "k string, v int"))
    monkeypatch.undo()
    assert rows(table.snapshot()) == [("a", 1)]
    v = table.append(spark.createDataFrame([("b", 2)], "k string, v int"))
    assert (v, rows(table.snapshot())) == (1, [("a", 1), ("b", 2)])


def test_refresh_writes_changed_buckets_only(spark):
    table = VersionedTable(spark, scratch(spark, "vt-refresh"), ["k"], 8)
    make = lambda *r: spark.createDataFrame(list(r), "k string, bucket int")
    a = [(f"k{i}", i) for i in range(40)]
    v0 = table.refresh(make(*a))
    assert table.refresh(make(*reversed(a))) == v0
    b = [(k, 99 if k == "k7" else v) for k, v in a]
    v1 = table.refresh(make(*b))
    assert len(table.files_changed(v0, v1)) == 1
    assert rows(table.changes(v0, v1)) == [("k7", 7, "delete", 1), ("k7", 99, "insert", 1)]
    assert table.refresh(make(*a)) == v0 and table.latest() == v1  # as it was: nothing is written
    assert table.refresh(make()) == v1 + 1 and table.snapshot().count() == 0


def test_pending_chunks_of_a_second_run(spark):
    kept = scratch(spark, "kept")
    chunks = spark.createDataFrame([(f"c{i}", "x", f"h{i}") for i in range(50)], "chunk_id string, content string, content_hash string")
    runs = spark.createDataFrame([("r1", "completed")], "run_id string, status string")
    log = spark.createDataFrame([("r1", f"c{i}", f"h{i}", "2025-01-01") for i in range(40)], "run_id string, chunk_id string, content_hash string, written_at string")
    from loamgraph.operators import incremental

    first = rows(pending_chunks(chunks, log, runs, kept))
    assert len(first) == 10
    answer = VersionedTable(spark, f"{kept}/pending", ["chunk_id"])
    state = VersionedTable(spark, f"{kept}/state", ["chunk_id"])
    versions = answer.latest(), state.latest()
    assert rows(pending_chunks(chunks, log, runs, kept)) == first
    assert (answer.latest(), state.latest()) == versions  # nothing changed: nothing is written, no delta is read
    more = log.union(spark.createDataFrame([("r1", "c45", "h45", "2025-01-02")], log.schema))
    assert rows(pending_chunks(chunks, more, runs, kept)) == [r for r in first if r != ("c45",)]
    assert len(state.files_changed(versions[1], state.latest())) >= 1
    assert incremental.pending_chunks(chunks, log, runs, kept).count() == 10  # a log that was taken back


def test_output_must_hold_the_key(spark, table):
    out = VersionedTable(spark, scratch(spark, "vt-other"), ["v"], 3)
    table.overwrite(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"))
    with pytest.raises(ValueError):
        run_incremental(table, out, lambda df: df.select("v"))
    run_incremental(table, out, lambda df: df.selectExpr("v * 10 v", "k of_key"), ["of_key"])
    table.upsert(spark.createDataFrame([("a", 5)], "k string, v int"))
    run_incremental(table, out, lambda df: df.selectExpr("v * 10 v", "k of_key"), ["of_key"])
    assert rows(out.snapshot()) == [(20, "b"), (50, "a")]
