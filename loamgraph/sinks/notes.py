"""Markdown notes and JSON pages of the graph, written by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_LINKS = 80  # Fixed value: links listed under a heading.


def node_notes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, note): name, kind, place, and at most 80 outgoing links with the number of the rest."""
    w = Window.partitionBy("source").orderBy("kind", "name")
    out = edges.join(nodes.select(F.col("node_id").alias("target"), "name"), "target").withColumn("r", F.row_number().over(w))
    line = F.concat(F.lit("- "), F.col("kind"), F.lit(" [["), F.col("name"), F.lit("]]"))
    links = out.groupBy(F.col("source").alias("node_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= MAX_LINKS, F.struct("r", line.alias("l"))))), lambda x: x["l"]), "\n").alias("links"), F.count(F.lit(1)).alias("n")
    )
    more = F.when(F.col("n") > MAX_LINKS, F.concat(F.lit("\n- … "), (F.col("n") - MAX_LINKS).cast("string"), F.lit(" more"))).otherwise("")
    head = F.concat(F.lit("# "), F.col("name"), F.lit("\nkind: "), F.col("kind"), F.lit("\nfile: "), F.coalesce("file_path", F.lit("n/a")), F.lit("\n"))
    body = F.when(F.col("links").isNotNull(), F.concat(F.lit("## Links\n"), F.col("links"), more, F.lit("\n"))).otherwise("")
    return nodes.join(links, "node_id", "left").select("node_id", F.concat(head, body).alias("note"))


def topics(nodes: DataFrame) -> DataFrame:
    """(repo_id, topic, notes): nodes by the first folder of their path."""
    topic = F.when(F.col("file_path").contains("/"), F.element_at(F.split("file_path", "/"), 1)).otherwise("root")
    return nodes.groupBy("repo_id", topic.alias("topic")).agg(F.count(F.lit(1)).alias("notes"))


def community_notes(communities: DataFrame, links: DataFrame) -> DataFrame:
    """(community_id, note): label, size and peers in both directions."""
    both = links.select(F.col("a").alias("community_id"), F.col("b").alias("peer"), "weight").unionByName(links.select(F.col("b").alias("community_id"), F.col("a").alias("peer"), "weight"))
    named = both.join(communities.select(F.col("community_id").alias("peer"), F.col("label").alias("peer_label")), "peer")
    r = F.row_number().over(Window.partitionBy("community_id").orderBy(F.desc("weight"), "peer"))
    peers = named.withColumn("r", r).filter(F.col("r") <= MAX_LINKS).groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "peer_label"))), lambda x: F.concat(F.lit("- "), x["peer_label"])), "\n").alias("peers"))
    return communities.join(peers, "community_id", "left").select("community_id", F.concat(F.lit("# "), F.col("label"), F.lit("\nmembers: "), F.size("members").cast("string"), F.lit("\n"), F.coalesce(F.concat(F.lit("## Peers\n"), F.col("peers"), F.lit("\n")), F.lit(""))).alias("note"))


def write_notes(notes: DataFrame, key: str, path: str) -> None:
    """One text row per note, in folders by the key's first letters; no note passes through the driver."""
    notes.select(F.substring(key, 1, 2).alias("shelf"), F.col("note").alias("value")).write.partitionBy("shelf").mode("overwrite").text(path)


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def page(title: str, rows: DataFrame, limit: int = 2000) -> str:
    """A standalone page with at most ``limit`` rows of a report as JSON, safe inside a script element."""
    data = [r.value for r in json_rows(rows).limit(limit).collect()]
    body = ("[" + ",".join(data) + "]").replace("</", "<\\/")
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1><script type="application/json" id="report-data">{body}</script></body></html>'
