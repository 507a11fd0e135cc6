"""Extractive summaries of communities, gated by their hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import layers as L

# Definition kinds, caps of the text, and the phrase of each layer.
DEFINITIONS = ["function", "method", "struct", "enum", "trait", "module", "test", "script", "deployment_resource"]
MAX_MEMBERS, MAX_SYMBOLS, MAX_FILES, MAX_CHARS, SNIPPET_CHARS = 200, 24, 12, 1600, 320
ROLES = {"entry": "entry point", "interface": "interface", "core": "core logic", "foundation": "foundation", "unknown": "supporting code"}


def _first(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= n)


def _ordered(column: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("_r", column))), lambda x: x[column])


def inputs(communities: DataFrame, members: DataFrame, nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per community: member count, first members, longest chunks; all bounded by rank before they are gathered."""
    rows = members.join(nodes.select("node_id", "kind", "name", "stable_id", F.coalesce("file_path", F.lit("")).alias("path")), "node_id")
    some = _first(rows, "community_id", ["kind", "name", "stable_id"], MAX_MEMBERS)
    listed = some.groupBy("community_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "name", "kind", "path"))), lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"), x["path"].alias("path"))).alias("members")
    )
    count = members.groupBy("community_id").agg(F.count(F.lit(1)).alias("member_count"))
    text = members.join(chunks.filter("node_id is not null").select("node_id", "content", "content_hash"), "node_id").select("community_id", "content", "content_hash").distinct()
    long_ = _first(text, "community_id", [F.desc(F.length("content")), "content_hash"], 5).groupBy("community_id").agg(_ordered("content").alias("snippets"))
    out = communities.select("community_id", "label").join(count, "community_id").join(listed, "community_id").join(long_, "community_id", "left")
    return out.withColumn("snippets", F.coalesce("snippets", F.array().cast("array<string>")))


def layer_vote(members: DataFrame) -> DataFrame:
    """(community_id, layer): plurality of the members' layers; unknown only where nothing else; ties outermost."""
    votes = members.groupBy("community_id", "layer").agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("layer") == "unknown", 1).otherwise(0)
    best = votes.groupBy("community_id").agg(F.min(F.struct(known.alias("u"), (-F.col("n")).alias("n"), L.rank(F.col("layer")).alias("r"), "layer")).alias("b"))
    return best.select("community_id", F.col("b.layer").alias("layer"))


def humanized(label: Column) -> Column:
    plain = F.array_join(F.filter(F.split(label, "[^A-Za-z0-9]+"), lambda x: x != ""), " ")
    return F.when(plain != label, F.concat(label, F.lit(" ("), plain, F.lit(")"))).otherwise(label)


def composed(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """(community_id, summary): label, role, key symbols, files, composition, snippets; cut to 1600 characters."""
    m = F.col("members")
    named = F.transform(F.filter(m, lambda x: x["kind"].isin(*DEFINITIONS)), lambda x: x["name"])
    other = F.transform(F.filter(m, lambda x: x["kind"] != "file"), lambda x: x["name"])
    symbols = F.slice(F.when(F.size(named) > 0, named).otherwise(other), 1, MAX_SYMBOLS)
    paths = F.slice(F.array_sort(F.array_distinct(F.filter(F.transform(m, lambda x: x["path"]), lambda p: p != ""))), 1, MAX_FILES)
    kinds = F.array_sort(F.array_distinct(F.transform(m, lambda x: x["kind"])))
    parts = F.transform(kinds, lambda k: F.concat(F.size(F.filter(m, lambda x: x["kind"] == k)).cast("string"), F.lit(" "), k))
    line = lambda head, items, join: F.when(F.size(items) > 0, F.concat(F.lit(head), F.array_join(items, join), F.lit(".\n"))).otherwise("")
    role = F.coalesce(*[F.when(F.col("layer") == k, v) for k, v in ROLES.items()], F.lit(ROLES["unknown"]))
    head = F.concat(
        humanized(F.col("label")), F.lit("\nRole: "), role, F.lit(".\n"), line("Key symbols: ", symbols, ", "), line("Files: ", paths, ", "),
        F.lit("Composition: "), F.array_join(parts, ", "), F.lit(" ("), F.col("member_count").cast("string"), F.lit(" members).\n"),
        F.when(F.size("snippets") > 0, "Representative code:\n").otherwise(""),
    )
    # snippets are added until the text has 1600 bytes
    full = F.aggregate("snippets", head, lambda acc, s: F.when((F.octet_length(acc) >= MAX_CHARS) & (F.octet_length(acc) > F.octet_length(head)), acc).otherwise(F.concat(acc, F.substring(s, 1, SNIPPET_CHARS), F.lit("\n"))))
    return rows.join(roles, "community_id", "left").select("community_id", F.substring(full, 1, MAX_CHARS).alias("summary"))


def stale(hashes: DataFrame, summaries: DataFrame, tag: str = "-sum3") -> DataFrame:
    """Communities whose summary was not made from the hash they have now."""
    return hashes.join(summaries.select("community_id", "summary_hash"), "community_id", "left").filter(~F.col("summary_hash").eqNullSafe(F.concat("hash", F.lit(tag)))).select("community_id", "hash")


def restored(pending: DataFrame, cache: DataFrame) -> DataFrame:
    """Pending communities whose summary is in the content-addressed cache."""
    return pending.join(cache.select("hash", "summary"), "hash").select("community_id", "summary")
