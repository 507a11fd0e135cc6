"""Small lookups: repositories, projects, communities, what lies under a path, and what a filter selects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from . import catalog as C

# Words that say nothing about which layer is meant.
LAYER_FILLER = ["features", "feature", "layer", "layers", "side", "code", "stuff", "things", "part", "parts", "level", "tier", "the", "all"]


def repositories(repos: DataFrame) -> DataFrame:
    """Each repository once, by name and root path."""
    last = repos.groupBy("repo_id").agg(F.max_by(F.struct("name", "root_path", "current_commit_sha"), "updated_at").alias("r"))
    return last.select("repo_id", "r.*").orderBy("name", "root_path")


def project(projects: DataFrame, name: str) -> DataFrame:
    return projects.filter(F.col("name") == name)


def members_of(members: DataFrame, project_id: str | None = None) -> DataFrame:
    rows = members if project_id is None else members.filter(F.col("project_id") == project_id)
    return rows.orderBy("project_id", "alias")


def briefs(communities: DataFrame, members: DataFrame) -> DataFrame:
    """(community_id, label, member_count), the largest first."""
    n = members.groupBy("community_id").agg(F.countDistinct("node_id").alias("member_count"))
    return communities.select("community_id", "label").join(n, "community_id").orderBy(F.desc("member_count"), "community_id")


def labels(communities: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    return briefs(communities, members).filter(F.col("member_count") >= least)


def communities_for_files(members: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(community_id) that have a member in one of the files (repo_id, file_path)."""
    at = nodes.select("node_id", "repo_id", "file_path").join(files.select("repo_id", "file_path").distinct(), ["repo_id", "file_path"], "left_semi")
    return members.join(at.select("node_id"), "node_id", "left_semi").select("community_id").distinct()


def symbols_under(nodes: DataFrame, folder: str) -> DataFrame:
    """Symbols in files of a folder, by path and line."""
    rows = nodes.filter(~F.col("kind").isin("file", "repository", "dependency") & C.in_folder(F.col("file_path"), folder))
    return rows.select("repo_id", "node_id", "kind", "name", "file_path", "line_start").orderBy("file_path", F.asc_nulls_last("line_start"), "name")


def communities_under(members: DataFrame, nodes: DataFrame, folders: list[str]) -> DataFrame:
    """(community_id, inside): communities with members under one of the folders."""
    inside = F.lit(False)
    for f in folders:
        inside = inside | C.in_folder(F.col("file_path"), f)
    return members.join(nodes.filter(inside).select("node_id"), "node_id", "left_semi").groupBy("community_id").agg(F.countDistinct("node_id").alias("inside"))


def manifest_dependency(kind: Column, stable_id: Column) -> Column:
    """A dependency that a manifest declares, as against one that a file imports."""
    return (kind == "dependency") & (stable_id.contains(":npm:dependency:") | stable_id.contains(":cargo:dependency:"))


def contracts(nodes: DataFrame) -> DataFrame:
    """(repo_id, name, kind, path): contracts, interfaces and libraries whose names are worth looking for elsewhere."""
    kind = F.get_json_object("metadata", "$.solidity_kind")
    name = F.col("name")
    linkable = (F.length(name) >= 5) & name.rlike("^[A-Z]") & ((F.length(name) >= 8) | name.rlike("^.+[A-Z]"))
    return nodes.filter((F.get_json_object("metadata", "$.language") == "solidity") & kind.isin("contract", "interface", "library") & linkable).select("repo_id", "name", kind.alias("kind"), F.coalesce("file_path", F.lit("")).alias("path"))


def layer_of_query(query: Column) -> Column:
    """The layer that a short query names: one word is left without the filler, and it is a layer's; else null."""
    words = F.filter(F.split(T.ascii_lower(query), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*LAYER_FILLER))
    layer = F.lit(None).cast("string")
    for name, of in reversed(list(V.WORD_LAYERS.items())):
        layer = F.when(F.element_at(words, 1).isin(*of), name).otherwise(layer)
    return F.when(F.size(words) == 1, layer)


def resolved_filter(query: Column, layer: Column | None = None, folder: Column | None = None, topic: Column | None = None, folders: Column | None = None) -> Column:
    """struct(kind, value, detected): a flag decides, layer before folder before topic; else a slash means a folder, a
    layer's word that layer, a known folder's name that folder, anything else a topic, and nothing all."""
    none = F.lit(None).cast("string")
    flag = lambda c: none if c is None else F.when(F.trim(c) != "", F.trim(c))
    q = flag(query)
    known = F.lit(False) if folders is None else F.coalesce(F.array_contains(folders, q), F.lit(False))
    auto = F.when(q.isNull(), "all").when(q.contains("/") | q.contains("\\"), "folder").when(layer_of_query(q).isNotNull(), "layer").when(known, "folder").otherwise("topic")
    flags = [("layer", flag(layer)), ("folder", flag(folder)), ("topic", flag(topic))]
    kind, value = auto, q
    for name, f in reversed(flags):
        kind, value = F.when(f.isNotNull(), name).otherwise(kind), F.coalesce(f, value)
    return F.struct(kind.alias("kind"), value.alias("value"), (F.coalesce(*[f for _, f in flags]).isNull() & q.isNotNull()).alias("detected"))


def curated(cards: DataFrame, wanted: DataFrame) -> DataFrame:
    """(group_no, place, title, label, note, card): a curation's features, each with the first unused card of that label,
    else the first unused card whose label ends in it; card is null where none is left.

    cards: card, label, order; wanted: group_no, place, title, label, note.  A curation is a page that a person wrote; the
    cards that could be meant are joined to it by equal label or ending, and only these are gathered.
    """
    ends = cards.select("card", F.col("label").alias("of"), "order", F.explode(F.transform(F.sequence(F.lit(1), F.length("label")), lambda i: F.substring("label", i, F.length("label")))).alias("label"))
    ends = ends.join(wanted.select("label").distinct(), "label", "left_semi")
    options = wanted.join(ends, "label", "left").withColumn("exact", (F.col("of") == F.col("label")).cast("int"))

    def run(b):
        import pandas as pd

        used: set = set()
        out = []
        for (g, p), rows in sorted(b.groupby(["group_no", "place"])):
            first = rows.iloc[0]
            free = rows[rows.card.notna() & ~rows.card.isin(used)].sort_values(["exact", "order", "card"], ascending=[False, True, True])
            card = free.card.iloc[0] if len(free) else None
            if card is not None:
                used.add(card)
            out.append((int(g), int(p), first.title, first.label, first.note, card))
        return pd.DataFrame(out, columns=["group_no", "place", "title", "label", "note", "card"])

    one = options.withColumn("curation", F.lit(1))
    return one.groupBy("curation").applyInPandas(lambda b: run(b), "group_no int, place int, title string, label string, note string, card string")


def selected(communities: DataFrame, members: DataFrame, nodes: DataFrame, kind: str, value: str | None = None) -> DataFrame:
    """(community_id, label): communities of two or more that a resolved filter selects: all, those of a folder or of a
    layer (by the plurality of their members), or those whose label or symbols speak of a topic."""
    from ..functions import layers as L
    from .summary import layer_vote

    big = labels(communities, members).select("community_id", "label")
    if kind == "all" or not value:
        return big
    if kind == "folder":
        return big.join(communities_under(members, nodes, [value]).select("community_id"), "community_id", "left_semi")
    if kind == "layer":
        votes = layer_vote(members.join(nodes.select("node_id", L.of_path(F.coalesce("file_path", F.lit("")), F.col("kind")).alias("layer")), "node_id"))
        named = layer_of_query(F.lit(value))
        return big.join(votes.filter(F.col("layer") == F.coalesce(named, F.lit(value))).select("community_id"), "community_id", "left_semi")
    words = [w for w in "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in value).split() if len(w) >= 3]
    hit = T.contains_any(F.lower("name"), words) if words else F.lit(False)
    speaks = members.join(nodes.filter(~F.col("kind").isin("file") & hit).select("node_id"), "node_id", "left_semi").select("community_id").distinct()
    by_label = big.filter(T.label_matches(F.col("label"), T.words(*words))) if words else big.limit(0)
    return by_label.unionByName(big.join(speaks, "community_id", "left_semi")).distinct()


def capped(anchors: DataFrame, per: str, most: int = 100) -> DataFrame:
    """The first ``most`` anchors of each consumer in order of name: a cap of the report's size, stated in ``dropped``."""
    w = Window.partitionBy(per).orderBy("name", "path", "repo_id")
    n = F.count(F.lit(1)).over(Window.partitionBy(per))
    return anchors.distinct().withColumns({"place": F.row_number().over(w), "dropped": F.greatest(n - most, F.lit(0))}).filter(F.col("place") <= most)
