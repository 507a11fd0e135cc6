"""The stack report: what manifests declare, scripts, deployment resources, configuration files, languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import reports as P
from .lookups import manifest_dependency


def _field(name: str):
    return F.get_json_object("metadata", f"$.{name}")


def dependencies(nodes: DataFrame) -> DataFrame:
    """(repo_id, ecosystem, name, version, section, manifest) of declared dependencies; imported ones are none."""
    rows = nodes.filter(manifest_dependency(F.col("kind"), F.col("stable_id")))
    ecosystem = F.when(F.col("stable_id").contains(":cargo:dependency:"), "cargo").otherwise("npm")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("repo_id", ecosystem.alias("ecosystem"), "name", empty(_field("version")).alias("version"), empty(_field("section")).alias("section"), empty(F.col("file_path")).alias("manifest"))


def scripts(nodes: DataFrame) -> DataFrame:
    rows = nodes.filter("kind = 'script'")
    return rows.select("repo_id", F.coalesce(_field("script"), "name").alias("name"), F.coalesce(_field("command"), F.lit("")).alias("command"), F.coalesce("file_path", F.lit("")).alias("manifest"))


def deployments(nodes: DataFrame) -> DataFrame:
    rows = nodes.filter("kind = 'deployment_resource'")
    empty = lambda *c: F.coalesce(*c, F.lit(""))
    kind = empty(_field("resource_kind"), F.when(F.col("stable_id").endswith(":aws-cdk:app"), "app"))
    return rows.select(
        "repo_id", "name", empty(_field("technology")).alias("technology"), kind.alias("resource_kind"), empty(_field("service")).alias("service"), empty(_field("app")).alias("app"),
        empty(_field("file"), _field("config"), F.col("file_path")).alias("file"), "line_start",
    )


def configs(chunks: DataFrame) -> DataFrame:
    """(repo_id, path): configuration files, by what their chunks say."""
    path = F.coalesce(_field("config"), F.col("file_path"), F.lit(""))
    return chunks.filter("chunk_type = 'config'").select("repo_id", path.alias("path")).filter("path <> ''").distinct()


def report(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(section, name, detail, n): the whole report in one relation."""
    p = P.packages(dependencies(nodes))
    s = P.scripts(scripts(nodes))
    i = P.infrastructure(deployments(nodes))
    row = lambda section, name, detail, n: [F.lit(section).alias("section"), name.alias("name"), detail.alias("detail"), n.cast("long").alias("n")]
    return (
        p.select(*row("package", F.concat_ws(":", "ecosystem", "name"), F.trim(F.concat_ws(" ", "versions", "scope")), F.col("manifests")))
        .unionByName(s.select(*row("script", F.col("name"), F.col("command"), F.col("manifests"))))
        .unionByName(i.select(*row("resource", F.concat_ws(":", "technology", "service"), F.col("examples"), F.col("resources"))))
        .unionByName(configs(chunks).groupBy("path").agg(F.count(F.lit(1)).alias("n")).select(*row("config", F.col("path"), F.lit(""), F.col("n"))))
    )


def overview(name: str, nodes: DataFrame) -> DataFrame:
    """One sentence for each ecosystem and technology."""
    p = P.packages(dependencies(nodes)).groupBy("ecosystem").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("scope") == "dev").cast("int")).alias("dev"))
    first = p.select(F.format_string(f"{name} declares %d %s packages, %d of them for development only.", F.col("n"), "ecosystem", "dev").alias("sentence"))
    i = P.infrastructure(deployments(nodes)).groupBy("technology").agg(F.sum("resources").alias("n"))
    return first.unionByName(i.select(F.format_string(f"{name} deploys %d resources with %s.", F.col("n"), "technology").alias("sentence")))
