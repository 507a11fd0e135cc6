"""Projects over several repositories, structure reports, search terms of editor events, and checks of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V


def stale_links(roots: DataFrame, linked: DataFrame) -> DataFrame:
    """(project, stale): a project is linked anew if any member's present root hash is not the one it was linked at.

    roots: repo_id, hash; linked: project, repo_id, linked_hash.
    """
    rows = linked.join(roots, "repo_id", "left")
    return rows.groupBy("project").agg(F.max((~F.col("hash").eqNullSafe(F.col("linked_hash"))).cast("int")).alias("stale"), F.count(F.lit(1)).alias("repositories"))


def project_status(linked: DataFrame, links: DataFrame) -> DataFrame:
    """(project, kind, links): cross-repository links of every project by kind; links: project, kind."""
    names = linked.select("project").distinct()
    return names.join(links.groupBy("project", "kind").agg(F.count(F.lit(1)).alias("links")), "project", "left").select("project", F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def event_term(tool: Column, payload: Column) -> Column:
    """Search term of an editor event: a pattern without its marks, else the longest word of a command, last of equals."""
    pattern = F.regexp_replace(F.get_json_object(payload, "$.pattern"), r"^[\W_]+|[\W_]+$", "")
    words = F.filter(F.regexp_extract_all(F.coalesce(F.get_json_object(payload, "$.command"), F.lit("")), F.lit(r"([A-Za-z_]\w{3,})"), F.lit(1)), lambda w: ~w.isin("grep", "find", "echo", "head", "tail", "sort"))
    longest = F.aggregate(words, F.lit(""), lambda a, w: F.when(F.length(w) >= F.length(a), w).otherwise(a))
    term = F.when(tool.isin("search", "glob"), pattern).when(tool == "shell", longest)
    return F.when(F.length(term) >= 3, term)


def changes_history(command: Column) -> Column:
    """The command changes the checked-out revision."""
    return T.contains_any(F.lower(command), V.MUTATING_COMMANDS)


def humanized_branch(branch: Column) -> Column:
    return F.trim(F.translate(F.element_at(F.split(branch, "/"), -1), "-_", "  "))


def domains(cards: DataFrame, most: int = 12) -> DataFrame:
    """(card, domain): cards grouped by the shortest folder prefix that holds at most ``most`` of them; what is alone
    rolls up to the folder above.  cards: card, path."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    above = cards.select("card", F.posexplode(steps).alias("level", "domain"))
    sizes = above.groupBy("domain").agg(F.countDistinct("card").alias("n"))
    rows = above.join(sizes, "domain").filter("n > 1")
    fit = F.min(F.when(F.col("n") <= most, F.struct("level", "domain")))
    deepest = F.max(F.struct("level", "domain"))
    found = rows.groupBy("card").agg(F.coalesce(fit["domain"], deepest["domain"]).alias("domain"))
    return cards.select("card").distinct().join(found, "card", "left").select("card", F.coalesce("domain", F.lit("other")).alias("domain"))


def structure(members: DataFrame, nodes: DataFrame, blob: int = 80) -> DataFrame:
    """Per repository: communities, upper median and greatest size, blobs, and glue (in files of other folders)."""
    sizes = members.groupBy("repo_id", "community_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("repo_id").orderBy("n", "community_id")
    ranked = sizes.withColumns({"r": F.row_number().over(w), "c": F.count(F.lit(1)).over(Window.partitionBy("repo_id"))})
    folder = F.element_at(F.split("file_path", "/"), 1)
    spread = members.join(nodes.filter("file_path is not null").select("node_id", folder.alias("folder")), "node_id").groupBy("repo_id", "community_id").agg(F.countDistinct("folder").alias("folders"))
    glue = spread.groupBy("repo_id").agg(F.sum((F.col("folders") > 1).cast("long")).alias("glue"))
    return ranked.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("communities"), F.max(F.when(F.col("r") == F.floor(F.col("c") / 2) + 1, F.col("n"))).alias("median"), F.max("n").alias("largest"), F.sum((F.col("n") >= blob).cast("long")).alias("blobs")
    ).join(glue, "repo_id", "left").select("repo_id", "communities", "median", "largest", "blobs", F.coalesce("glue", F.lit(0)).alias("glue"))


def page_scores(pages: DataFrame, tokens: list[str]) -> DataFrame:
    """(page, score): three for each occurrence of a token in the head, one for each in its items.
    pages: page, head, items array<string>."""
    t = T.words(*tokens)
    return pages.select("page", (3 * T.score_text(t, F.col("head")) + T.score_text(t, F.array_join("items", " "))).alias("score")).filter("score > 0")


def manifest_faults(manifests: DataFrame) -> DataFrame:
    """(page, fault): minimums of a page's manifest that are not met.  manifests: page, manifest (JSON)."""
    # The least number of each part.
    least = {"claims": 3, "modes": 2, "nodes": 5, "edges": 3, "story": 3}
    size = lambda k: F.coalesce(F.json_array_length(F.get_json_object("manifest", f"$.{k}")), F.lit(0))
    faults = F.array(*[F.when(size(k) < n, f"{k} below {n}") for k, n in least.items()])
    return manifests.select("page", F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("fault"))


def components(communities: DataFrame, scores: DataFrame, links: DataFrame, most: int = 40) -> DataFrame:
    """(area, community_id, place, needs): an area's communities, best first, with the others of the area they need.

    scores: area, community_id, score; links: a, b (a depends on b).
    """
    w = Window.partitionBy("area").orderBy(F.desc("score"), "community_id")
    chosen = scores.groupBy("area", "community_id").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    other = chosen.select("area", F.col("community_id").alias("b"))
    needs = links.join(chosen.select("area", F.col("community_id").alias("a")), "a").join(other, ["area", "b"]).groupBy("area", "a").agg(F.countDistinct("b").alias("needs"))
    return chosen.join(needs.withColumnRenamed("a", "community_id"), ["area", "community_id"], "left").join(communities.select("community_id", "label"), "community_id").select("area", "community_id", "label", "place", F.coalesce("needs", F.lit(0)).cast("long").alias("needs"))
