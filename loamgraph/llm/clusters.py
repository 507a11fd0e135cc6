"""Problem 3: density-peak clusters of detected communities by the overlap of their members.

Detections with equal member sets are one class.  Classes of one repository that share a prefix token (members in
order of rarity) within the length and positional bounds are compared exactly; that is the neighbour join.  Local
density is the number of detections within the threshold; every class points to its nearest denser neighbour
(greatest Jaccard index, then smallest id), classes without one are peaks, and pointers are followed by doubling.
As similarity links may run between two peaks' basins, basins with a link are joined afterwards (exact check), so
a cluster is a connected group.

Defined results: null arrays have no cluster; null members are dropped and repeated ones count once; an empty set
is similar to nothing; repeated rows count once; a null repo_id is a repository of its own; other columns, also
those with clashing names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, stored

THRESHOLD = 0.5
#: Sets that share a prefix token are compared in blocks of about so many.
BLOCK = 2048


def _classes(detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(detection_id, class_id) and (class_id, repo, members, n, copies)."""
    members = F.array_sort(F.array_distinct(F.filter("member_node_ids", lambda m: m.isNotNull())))
    rows = (
        detections.filter("member_node_ids is not null and detection_id is not null")
        .select("detection_id", F.coalesce("repo_id", F.lit("")).alias("repo"), members.alias("members"))
        .filter(F.size("members") > 0)
        .dropDuplicates(["detection_id"])
        .withColumn("key", F.sha2(F.to_json(F.struct("repo", "members")), 256))
    )
    rows = stored(rows, "detections")
    ids = rows.groupBy("key").agg(F.min("detection_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    of = rows.select("detection_id", "key").join(ids, "key").select("detection_id", "class_id")
    sets = rows.join(ids.withColumnRenamed("class_id", "detection_id"), ["detection_id", "key"]).select(
        F.col("detection_id").alias("class_id"), "repo", "members", F.size("members").alias("n"), "copies"
    )
    return of, stored(sets, "member-sets")


def _links(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim), a < b: all pairs of classes of one repository with a Jaccard index of at least the threshold."""
    tokens = sets.select("class_id", "repo", "n", F.explode("members").alias("m"))
    df = tokens.groupBy("repo", "m").agg(F.count(F.lit(1)).alias("df"))
    ordered = (
        tokens.join(df, ["repo", "m"])
        .filter("df > 1")
        .groupBy("class_id", "repo", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "m"))).alias("shared"))
        # members nobody else has come first in the order of rarity, so they fill the first places
        .withColumn("alone", F.col("n") - F.size("shared"))
        .withColumn("prefix", F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1)
        .withColumn("keep", F.greatest(F.lit(0), F.least(F.size("shared"), F.col("prefix") - F.col("alone"))))
        .filter("keep > 0")
        .select("class_id", "repo", "n", "alone", F.posexplode(F.slice("shared", F.lit(1), F.col("keep"))).alias("i", "s"))
        .select("class_id", "repo", "n", (F.col("alone") + F.col("i")).alias("pos"), F.col("s.m").alias("m"))
    )
    ordered = stored(ordered, "prefixes")
    # a token that very many sets share would be one task's work: its sets are hashed into blocks, and every pair of blocks
    # is a key of its own
    hot = ordered.groupBy("repo", "m").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    ordered = (
        ordered.join(hot, ["repo", "m"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("class_id", "repo", "n", "pos", "m", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    )
    key = ["repo", "m", "lo", "hi"]
    side = lambda p: ordered.select([F.col(c).alias(c if c in key else f"{c}_{p}") for c in ordered.columns])
    t = F.lit(threshold)
    need = F.ceil(t / (1 + t) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    pairs = (
        side("a")
        .join(side("b"), key)
        .filter("class_id_a < class_id_b and (block_a <> block_b or lo = hi)")
        .filter((F.least("n_a", "n_b") >= t * F.greatest("n_a", "n_b") - 1e-9))
        .filter(1 + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) - 1 + F.least("pos_a", "pos_b") >= need)
        .select("class_id_a", "class_id_b")
        .distinct()
    )
    half = lambda p: sets.select(F.col("class_id").alias(f"class_id_{p}"), F.col("members").alias(f"m_{p}"))
    both = F.size(F.array_intersect("m_a", "m_b"))
    return (
        pairs.join(half("a"), "class_id_a")
        .join(half("b"), "class_id_b")
        .withColumn("both", both)
        .withColumn("sim", F.col("both") / (F.size("m_a") + F.size("m_b") - F.col("both")))
        .filter(F.col("sim") >= threshold)
        .select(F.col("class_id_a").alias("a"), F.col("class_id_b").alias("b"), "sim")
    )


def follow(pointers: DataFrame) -> DataFrame:
    """(id, up) with roots pointing at themselves -> (id, root), by pointer doubling."""
    now = cut(pointers)
    while True:
        nxt = cut(
            now.alias("x")
            .join(now.alias("y"), F.col("x.up") == F.col("y.id"), "left")
            .select(F.col("x.id").alias("id"), F.coalesce("y.up", "x.up").alias("up"), (~F.coalesce("y.up", "x.up").eqNullSafe(F.col("x.up"))).alias("moved"))
        )
        moved = nxt.filter("moved").limit(1).count()
        now = nxt.drop("moved")
        if not moved:
            return now.withColumnRenamed("up", "root")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) -> (id, root): connected components by alternating stars; root is the smallest id.

    Each round links every node's greater neighbours, then all its neighbours, to the smallest one it knows, so the
    number of rounds grows with the logarithm of the diameter and no node's neighbours are gathered in one row.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least2.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = cut(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))


def density_peaks(detections: DataFrame, threshold: float = THRESHOLD) -> dict[str, DataFrame]:
    """of: detection -> class; sets; links; basins: class -> (peak, density)."""
    of, sets = _classes(detections)
    links = stored(_links(sets, threshold), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    near = both.join(sets.select(F.col("class_id").alias("b"), F.col("copies").alias("copies_b")), "b")
    around = near.groupBy("a").agg(F.sum("copies_b").alias("others"))
    density = stored(
        sets.select(F.col("class_id").alias("id"), "copies")
        .join(around.withColumnRenamed("a", "id"), "id", "left")
        .select("id", (F.col("copies") + F.coalesce("others", F.lit(0))).alias("density")),
        "density",
    )
    d = lambda p: density.select(F.col("id").alias(p), F.col("density").alias(f"d{p}"))
    denser = both.join(d("a"), "a").join(d("b"), "b").filter("db > da or (db = da and b < a)")
    up = denser.groupBy("a").agg(F.min(F.struct((-F.col("sim")).alias("s"), "b")).alias("best")).select(F.col("a").alias("id"), F.col("best.b").alias("up"))
    pointers = density.join(up, "id", "left").select("id", F.coalesce("up", "id").alias("up"))
    basins = follow(pointers).join(density, "id").select("id", F.col("root").alias("peak"), "density")
    return {"of": of, "sets": sets, "links": links, "basins": stored(basins, "basins")}


def clusters(detections: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(cluster_id, detection_id, class_id, density): members of every connected group of two or more."""
    p = density_peaks(detections, threshold)
    peak = lambda c: p["basins"].select(F.col("id").alias(c), F.col("peak").alias(f"p{c}"))
    bridges = p["links"].join(peak("a"), "a").join(peak("b"), "b").filter("pa <> pb").select(F.col("pa").alias("u"), F.col("pb").alias("v"))
    joined = components(bridges)
    group = p["basins"].join(joined.withColumnRenamed("id", "peak"), "peak", "left").select(F.col("id").alias("class_id"), F.coalesce("root", "peak").alias("g"), "density")
    rows = stored(p["of"].join(group, "class_id"), "members")
    named = rows.groupBy("g").agg(F.min("detection_id").alias("cluster_id"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    return rows.join(named, "g").select("cluster_id", "detection_id", "class_id", "density")


def cluster_report(detections: DataFrame, threshold: float = THRESHOLD, top: int = 5) -> DataFrame:
    """Per cluster: its detections, true size (distinct members over them) and most typical members (in most
    detections, then by id), beside the size and top members that its densest detection states."""
    base = detections.filter("member_node_ids is not null").dropDuplicates(["detection_id"])
    rows = clusters(detections, threshold)
    stated = base.select("detection_id", F.col("size").alias("stated_size"), F.transform("top_members", lambda m: m["stable_id"]).alias("stated_top"), F.array_distinct("member_node_ids").alias("members"))
    full = stored(rows.join(stated, "detection_id"), "report")
    member = full.select("cluster_id", F.explode("members").alias("m")).filter("m is not null").groupBy("cluster_id", "m").agg(F.count(F.lit(1)).alias("c"))
    # min_by over single best would lose ties; a bounded list per cluster is kept by rank
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("c"), "m"))
    typical = (
        member.withColumn("r", rank)
        .groupBy("cluster_id")
        .agg(F.count(F.lit(1)).alias("true_size"), F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "m")))).alias("t"))
        .select("cluster_id", "true_size", F.transform("t", lambda x: x["m"]).alias("typical_members"))
    )
    best = full.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("detections"), F.min(F.struct((-F.col("density")).alias("d"), "detection_id", "stated_size", "stated_top")).alias("b"))
    return best.join(typical, "cluster_id").select(
        "cluster_id", "detections", "true_size", "typical_members", F.col("b.stated_size").alias("stated_size"), F.col("b.stated_top").alias("stated_top")
    )
