"""Links between repositories: shared packages, symbols and routes, resolved to communities and aggregated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import routes as Ro
from ..functions import text as T
from ..functions import vocabulary as V
from ..sources import extract as X

CONFIDENCE = {**V.LINK_CONFIDENCE, "package": V.LINK_CONFIDENCE["package_dep"], "symbol": V.LINK_CONFIDENCE["abi"], "route": V.LINK_CONFIDENCE["http_route"]}


def name_matches(definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """(kind, name, from_repo, from_path, to_repo, to_path): a name used in one repository and defined in exactly one
    other.  Equal keys only; a name defined in several repositories says nothing and is left out before the join."""
    single = definitions.groupBy("kind", "name").agg(F.countDistinct("repo_id").alias("n"), F.min("repo_id").alias("to_repo"), F.min("path").alias("to_path")).filter("n = 1").drop("n")
    return uses.select("kind", "name", F.col("repo_id").alias("from_repo"), F.col("path").alias("from_path")).join(single, ["kind", "name"]).filter("from_repo <> to_repo")


def aggregated(matches: DataFrame, places: DataFrame) -> DataFrame:
    """(kind, source, target, total, names, confidence): one link per pair of communities and kind, with up to six names.

    places: (repo_id, file_path, community_id), the community that has most of a file.
    """
    at = lambda r, p, c: places.select(F.col("repo_id").alias(r), F.col("file_path").alias(p), F.col("community_id").alias(c))
    rows = matches.join(at("from_repo", "from_path", "source"), ["from_repo", "from_path"]).join(at("to_repo", "to_path", "target"), ["to_repo", "to_path"]).filter("source <> target")
    per_name = rows.groupBy("kind", "source", "target", "name").agg(F.count(F.lit(1)).alias("n"))
    ranked = per_name.withColumn("r", F.row_number().over(Window.partitionBy("kind", "source", "target").orderBy("name")))
    conf = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in CONFIDENCE.items()], F.lit(0.5))
    return ranked.groupBy("kind", "source", "target").agg(
        F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= 6, F.col("name")))), ",").alias("names")
    ).withColumn("confidence", conf)


# -- what repositories offer and use ---------------------------------------------------------------------------
def packages(files: DataFrame) -> DataFrame:
    """(repo_id, name, dir): packages that the repositories' manifests publish."""
    return X.manifest_names(files).select("repo_id", "name", T.dir_of(F.col("path")).alias("dir")).distinct()


def routes(chunks: DataFrame) -> DataFrame:
    """(repo_id, route, path) registered; chunks: repo_id, path, content."""
    return _routes(chunks, Ro.registered(F.col("content")))


def calls(chunks: DataFrame) -> DataFrame:
    """(repo_id, route, path) called."""
    return _routes(chunks, Ro.called(F.col("content")))


def _routes(chunks: DataFrame, found) -> DataFrame:
    raw = chunks.filter("content is not null").select("repo_id", F.explode(found).alias("raw"), "path")
    return raw.select("repo_id", Ro.normalized(F.col("raw")).alias("route"), "path").filter("route is not null").distinct()


_MODULE = r"""(?:\bfrom|\bimport|require\()\s*["'`]([^"'`\n]+)["'`]"""
_CRATE = r"\b(?:use|extern crate)\s+([A-Za-z_]\w*)(?:::|;|\s)"


def package_matches(published: DataFrame, chunks: DataFrame) -> DataFrame:
    """(kind, name, from_repo, from_path, to_repo, to_dir): imports of a package that another repository publishes; the
    name itself, or a module below it, or its crate's name.  Equal keys only."""
    module = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(_MODULE), F.lit(1)))).alias("m")
    js = chunks.filter("content is not null").select("repo_id", "path", module)
    js = js.select("repo_id", "path", F.explode(F.array_distinct(F.array(F.col("m"), T.import_package(F.col("m"))))).alias("key"))
    crate = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(_CRATE), F.lit(1)))).alias("key")
    rust = chunks.filter("content is not null").select("repo_id", "path", crate)
    offered = published.select(F.col("repo_id").alias("to_repo"), "name", F.col("dir").alias("to_dir"))
    by_js = js.join(offered.withColumn("key", F.col("name")), "key")
    by_rust = rust.join(offered.withColumn("key", F.translate("name", "-", "_")), "key")
    both = by_js.unionByName(by_rust).filter("repo_id <> to_repo")
    return both.select(F.lit("package_dep").alias("kind"), "name", F.col("repo_id").alias("from_repo"), F.col("path").alias("from_path"), "to_repo", "to_dir").distinct()


def route_matches(called: DataFrame, registered: DataFrame) -> DataFrame:
    """(kind, name, from_repo, from_path, to_repo, to_path): calls of a route that another repository registers.

    Two routes that match have a segment in common at the same place from the end, so that is the key they are joined by;
    each pair is then compared segment by segment, once.
    """
    parts = F.reverse(F.filter(F.split("route", "/"), lambda x: x != ""))
    unique = lambda df: df.select("route").distinct().select("route", F.posexplode(parts).alias("at", "part")).filter("part <> '*'")
    a = unique(called).withColumnRenamed("route", "a")
    b = unique(registered).withColumnRenamed("route", "b")
    pairs = a.join(b, ["at", "part"]).select("a", "b").distinct().filter(Ro.match(F.col("a"), F.col("b")))
    asks = called.select(F.col("route").alias("a"), F.col("repo_id").alias("from_repo"), F.col("path").alias("from_path"))
    has = registered.select(F.col("route").alias("b"), F.col("repo_id").alias("to_repo"), F.col("path").alias("to_path"))
    rows = pairs.join(asks, "a").join(has, "b").filter("from_repo <> to_repo")
    return rows.select(F.lit("http_route").alias("kind"), F.col("b").alias("name"), "from_repo", "from_path", "to_repo", "to_path").distinct()


def package_places(members: DataFrame, nodes: DataFrame, published: DataFrame) -> DataFrame:
    """(repo_id, dir, community_id): the largest community with members under a package's directory ('': anywhere)."""
    folders = F.transform(F.sequence(F.lit(1), F.size(F.split("file_path", "/"))), lambda i: F.array_join(F.slice(F.split("file_path", "/"), F.lit(1), i - 1), "/"))
    at = nodes.filter("file_path is not null").select("node_id", "repo_id", F.explode(folders).alias("dir")).join(published.select("repo_id", "dir").distinct(), ["repo_id", "dir"], "left_semi")
    size = members.groupBy("community_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    inside = members.select("community_id", "node_id").join(at, "node_id").select("repo_id", "dir", "community_id").distinct().join(size, "community_id")
    return inside.groupBy("repo_id", "dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "community_id")).alias("b")).select("repo_id", "dir", "b.community_id")
