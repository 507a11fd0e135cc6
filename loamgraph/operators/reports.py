"""Aggregate reports: dependencies, scripts, deployment, impact, correlation, features, change plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def scope(section: Column) -> Column:
    return F.when(section.isin("devDependencies", "dev-dependencies", "build-dependencies"), "dev").otherwise("runtime")


def packages(rows: DataFrame) -> DataFrame:
    """Per package: up to four versions in the order of manifests, scope, manifests.  rows: ecosystem, name, version,
    section, manifest."""
    s = scope(F.col("section"))
    base = rows.withColumns({"dev": (s == "dev").cast("int"), "run": (s != "dev").cast("int")})
    versions = base.filter("version <> ''").groupBy("ecosystem", "name", "version").agg(F.min("manifest").alias("m"))
    w = Window.partitionBy("ecosystem", "name").orderBy("m", "version")
    few = versions.withColumn("r", F.row_number().over(w)).filter("r <= 4").groupBy("ecosystem", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "version"))), lambda x: x["version"]), ",").alias("versions"))
    agg = base.groupBy("ecosystem", "name").agg(F.max("dev").alias("d"), F.max("run").alias("t"), F.countDistinct("manifest").alias("manifests"))
    return agg.join(few, ["ecosystem", "name"], "left").select(
        "ecosystem", "name", F.coalesce("versions", F.lit("")).alias("versions"), F.when(F.col("d") + F.col("t") == 2, "mixed").when(F.col("d") == 1, "dev").otherwise("runtime").alias("scope"), "manifests"
    )


def scripts(rows: DataFrame) -> DataFrame:
    """Per script name: manifests, and the first command that is not empty."""
    return rows.groupBy("name").agg(F.countDistinct("manifest").alias("manifests"), F.coalesce(F.min_by(F.when(F.col("command") != "", F.col("command")), F.when(F.col("command") != "", F.col("manifest"))), F.lit("")).alias("command"))


def infrastructure(rows: DataFrame) -> DataFrame:
    """Per technology and service: resources and the first three names."""
    tech = F.when(F.coalesce("technology", F.lit("")) == "", "unknown").otherwise(F.col("technology"))
    named = rows.withColumn("technology", tech).withColumn("r", F.row_number().over(Window.partitionBy("technology", "service").orderBy("name", "file")))
    return named.groupBy("technology", "service").agg(F.count(F.lit(1)).alias("resources"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "name")))), lambda x: x["name"]), ",").alias("examples"))


def impact(hits: DataFrame, files: int = 24) -> DataFrame:
    """Per file: hits, best score, whether any is code; code before documents, then by score."""
    doc = F.col("chunk_type").isin("documentation", "config")
    rows = hits.groupBy("question", "path").agg(F.count(F.lit(1)).alias("hits"), F.round(F.max("score"), 6).alias("score"), F.max((~doc).cast("int")).alias("code"))
    w = Window.partitionBy("question").orderBy(F.desc("code"), F.desc("score"), "path")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= files)


def correlated(pages: DataFrame) -> DataFrame:
    """(a, b, score): pages that share files (two each) or symbols (one each).  pages: page, kind, item."""
    p = pages.select("page", "kind", F.lower("item").alias("item")).distinct()
    a, b = p.withColumnRenamed("page", "a"), p.withColumnRenamed("page", "b")
    return a.join(b, ["kind", "item"]).filter("a < b").groupBy("a", "b").agg(F.sum(F.when(F.col("kind") == "file", 2).otherwise(1)).alias("score"))


def change_plan(semantic: DataFrame, changed: DataFrame, size: int = 8) -> DataFrame:
    """(community_id, confidence, reasons): communities found by meaning or touched by a change; the latter are
    certain.  semantic: community_id, score."""
    rows = semantic.select("community_id", F.col("score").alias("confidence"), F.lit("semantic").alias("why")).unionByName(changed.select("community_id", F.lit(1.0).alias("confidence"), F.lit("diff").alias("why")))
    out = rows.groupBy("community_id").agg(F.round(F.max("confidence"), 6).alias("confidence"), F.array_join(F.array_sort(F.collect_set("why")), "+").alias("reasons"))
    return out.orderBy(F.desc("confidence"), "community_id").limit(size)


def features(communities: DataFrame, members: DataFrame, nodes: DataFrame, topic: list[str]) -> DataFrame:
    """(community_id, label, matched, symbols): communities whose label or members speak of the topic."""
    words = T.words(*topic)
    names = members.join(nodes.filter("kind <> 'file'").select("node_id", "name"), "node_id").groupBy("community_id").agg(
        F.count(F.lit(1)).alias("symbols"), F.sum(F.when(reduce(lambda a, b: a | b, [F.lower("name").contains(t) for t in topic]), 1).otherwise(0)).alias("matched")
    )
    return communities.select("community_id", "label").join(names, "community_id").filter(T.label_matches(F.col("label"), words) | (F.col("matched") > 0)).select("community_id", "label", "matched", "symbols")


def context_warnings(task_words: DataFrame, files: DataFrame, hits: DataFrame) -> DataFrame:
    """Words of a task that are paths of the repository and in no hit."""
    return task_words.join(files.select(F.col("path").alias("word")).distinct(), "word", "left_semi").join(hits.select(F.col("path").alias("word")).distinct(), "word", "left_anti")
