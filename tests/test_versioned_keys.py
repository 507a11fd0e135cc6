from loamgraph.operators.versioned import VersionedTable, run_incremental
from loamgraph.session import scratch


def rows(df):
    return sorted(map(tuple, df.collect()))


def tables(spark):
    return [VersionedTable(spark, scratch(spark, n), ["k"], 3) for n in ("vk", "vk-out")]


def test_untouched_rows_of_a_touched_key_stay(spark):
    make = lambda *r: spark.createDataFrame(list(r), "k string, h string")
    table, out = tables(spark)
    table.overwrite(make(("k", "h1"), ("k", "h2"), ("x", "h1")))
    run_incremental(table, out, lambda df: df)
    table.overwrite(make(("k", "h1"), ("k", "h3"), ("x", "h1")))
    run_incremental(table, out, lambda df: df)
    assert rows(out.snapshot()) == [("k", "h1"), ("k", "h3"), ("x", "h1")]
    table.append(make(("x", "h2"), ("x", "h2")))
    run_incremental(table, out, lambda df: df)
    assert rows(out.snapshot()) == [("k", "h1"), ("k", "h3"), ("x", "h1"), ("x", "h2"), ("x", "h2")]
    table.delete(make(("x", "")).select("k"))
    run_incremental(table, out, lambda df: df)
    assert rows(out.snapshot()) == [("k", "h1"), ("k", "h3")]


def test_an_equal_file_that_is_appended_counts(spark):
    one = spark.createDataFrame([("a", "h")], "k string, h string")
    table, out = tables(spark)
    v0 = table.overwrite(one)
    run_incremental(table, out, lambda df: df)
    table.append(one)
    v2 = table.append(one)
    assert rows(table.changes(v0, v2)) == [("a", "h", "insert", 2)]
    v3 = table.overwrite(one)
    assert rows(table.changes(v2, v3)) == [("a", "h", "delete", 2)]
    assert table.changes(v0, v3).count() == 0
    table.append(one)
    run_incremental(table, out, lambda df: df)
    assert rows(out.snapshot()) == [("a", "h"), ("a", "h")]
