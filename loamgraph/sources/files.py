"""Reading source trees and report pages from storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_indexable, language_of

# Directories left out of a walk, and the markers of report pages in order of precedence.
SKIP_DIRS = [".git", "target", "node_modules", ".venv", "dist", "build"]
PAGE_MARKERS = ["feature-manifest", "change-manifest", "storyboard-data", "plan-data", "impact-data", "components-data", "features-data", "stack-data"]


def source_tree(spark: SparkSession, root: str, repo_id: str, skip_dirs: list[str] | None = None) -> DataFrame:
    """(repo_id, path, language, content, content_hash) of the indexable files below a root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = root.rstrip("/").split(":")[-1]
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), f"^/*{at.lstrip('/')}/", "")
    rows = raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"))
    dirs = F.split("path", "/")
    skipped = F.arrays_overlap(F.slice(dirs, F.lit(1), F.greatest(F.size(dirs) - 1, F.lit(0))), F.array(*[F.lit(x) for x in (skip_dirs or SKIP_DIRS)]))
    rows = rows.filter(is_indexable(F.col("path")) & ~skipped)
    return rows.select(F.lit(repo_id).alias("repo_id"), "path", language_of(F.col("path")).alias("language"), "content", F.sha2("content", 256).alias("content_hash"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, title, manifest) of the HTML pages of a folder; kind by the first marker found."""
    raw = spark.read.text(f"{folder}/*.html", wholetext=True).select(F.col("_metadata.file_name").alias("path"), F.col("value").alias("html"))
    kind = F.coalesce(*[F.when(F.col("html").contains(f'id="{m}"'), F.regexp_replace(F.lit(m), "-(manifest|data)$", "")) for m in PAGE_MARKERS], F.lit("other"))
    block = F.regexp_extract("html", r'(?s)<script[^>]*id="[a-z\-]+"[^>]*>(.*?)</script>', 1)
    title = F.coalesce(F.get_json_object(block, "$.title"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))
    return raw.select("path", kind.alias("kind"), F.trim(title).alias("title"), F.trim(block).alias("manifest"))
