"""Graph operators: coupling weights, quotient graph, modularity, neighbours, bounded paths, Louvain, order, trees."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def pair_weights(edges: DataFrame) -> DataFrame:
    """(repo_id, a, b, weight, links): confidence over cost, summed over each unordered pair."""
    w = F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)) / F.greatest("cost", F.lit(1e-6))
    ends = edges.filter("source <> target").select("repo_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), w.alias("w"))
    return ends.groupBy("repo_id", "a", "b").agg(F.round(F.sum("w"), 6).alias("weight"), F.count(F.lit(1)).alias("links"))


def quotient(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, weight, links, kind): links between different communities; the commonest kind, ties by name."""
    m = lambda end, c: members.select(F.col("node_id").alias(end), F.col("community_id").alias(c))
    w = F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)) / F.greatest("cost", F.lit(1e-6))
    rows = edges.join(m("source", "x"), "source").join(m("target", "y"), "target").filter("x <> y")
    per_kind = rows.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "kind").agg(F.sum(w).alias("w"), F.count(F.lit(1)).alias("n"))
    return per_kind.groupBy("a", "b").agg(
        F.round(F.sum("w"), 6).alias("weight"), F.sum("n").alias("links"), F.min(F.struct((-F.col("n")).alias("n"), "kind")).alias("best")
    ).select("a", "b", "weight", "links", F.col("best.kind").alias("kind"))


def directed_links(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, n): edges from members of one community to members of another."""
    m = lambda end, c: members.select(F.col("node_id").alias(end), F.col("community_id").alias(c))
    return edges.join(m("source", "a"), "source").join(m("target", "b"), "target").filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def modularity(pairs: DataFrame, labels: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Per repository: sum over labels of inside weight over total, less gamma times the squared share of degree."""
    p = pairs.join(labels.select(F.col("node_id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node_id").alias("b"), F.col("label").alias("lb")), "b")
    ends = p.select("repo_id", F.col("la").alias("label"), "weight").unionByName(p.select("repo_id", F.col("lb").alias("label"), "weight"))
    degree = ends.groupBy("repo_id", "label").agg(F.sum("weight").alias("deg"))
    inside = p.filter("la = lb").groupBy("repo_id", F.col("la").alias("label")).agg(F.sum("weight").alias("inside"))
    total = p.groupBy("repo_id").agg(F.sum("weight").alias("m"))
    q = F.coalesce("inside", F.lit(0.0)) / F.col("m") - gamma * F.pow(F.col("deg") / (2 * F.col("m")), 2)
    return degree.join(inside, ["repo_id", "label"], "left").join(total, "repo_id").groupBy("repo_id").agg(F.round(F.sum(q), 6).alias("modularity"))


def internal_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct unordered pairs of linked members per community."""
    m = lambda end: members.select(F.col("node_id").alias(end), "community_id")
    both = edges.filter("source <> target").join(m("source"), "source").join(m("target"), ["target", "community_id"])
    return both.select("community_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct().groupBy("community_id").agg(F.count(F.lit(1)).alias("pairs"))


def one_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Neighbours of the seeds in either direction that are no seeds themselves."""
    s = seeds.select("node_id").distinct()
    out = edges.join(s.withColumnRenamed("node_id", "source"), "source", "left_semi").select(F.col("target").alias("node_id"))
    into = edges.join(s.withColumnRenamed("node_id", "target"), "target", "left_semi").select(F.col("source").alias("node_id"))
    return out.unionByName(into).distinct().join(s, "node_id", "left_anti")


def cheapest_paths(edges: DataFrame, seeds: DataFrame, hops: int | None = None, backwards: float = 0.15, nodes: bool = False) -> DataFrame:
    """(start, end, cost, hops): least cost from each seed to other seeds, over at most ``hops`` edges if that is given; an
    edge may be used against its direction at a surcharge.  With ``nodes`` also the way.  Relaxation from what the last
    round improved, one join and one minimum a round, until nothing does; a way dearer than the dearest known one from
    its start to any seed cannot shorten one and isn't followed once all seeds are reached."""
    both = edges.select("source", "target", "cost").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), (F.col("cost") + backwards).alias("cost")))
    arcs = both.filter("source <> target").groupBy("source", "target").agg(F.min("cost").alias("cost"))
    s = seeds.select("node_id").distinct()
    n = s.count()
    path = F.array("node_id") if nodes else F.array().cast("array<string>")
    best = cut(s.select(F.col("node_id").alias("start"), F.col("node_id").alias("at"), F.lit(0.0).alias("total"), F.lit(0).alias("hops"), path.alias("nodes")))
    front, done = best, 0
    while hops is None or done < hops:
        more = F.concat("nodes", F.array("target")) if nodes else F.col("nodes")
        step = front.join(arcs.withColumnRenamed("source", "at"), "at").select("start", F.col("target").alias("at"), (F.col("total") + F.col("cost")).alias("total"), (F.col("hops") + 1).alias("hops"), more.alias("nodes"))
        reached = best.join(s.withColumnRenamed("node_id", "at"), "at", "left_semi").groupBy("start").agg(F.max("total").alias("bound"), F.count(F.lit(1)).alias("k"))
        step = step.join(reached, "start").filter((F.col("k") < n) | (F.col("total") < F.col("bound"))).drop("bound", "k")
        step = step.groupBy("start", "at").agg(F.min(F.struct(F.round("total", 9).alias("r"), "hops", "nodes", "total")).alias("b")).select("start", "at", "b.total", "b.hops", "b.nodes")
        known = best.select("start", "at", F.col("total").alias("was"))
        front = cut(step.join(known, ["start", "at"], "left").filter("was is null or total < was - 1e-9").drop("was"))
        done += 1
        if not front.limit(1).count():
            break
        best = cut(best.join(front.select("start", "at"), ["start", "at"], "left_anti").unionByName(front))
    out = best.join(s.withColumnRenamed("node_id", "at"), "at", "left_semi").filter("start <> at")
    return out.select("start", F.col("at").alias("end"), F.round("total", 6).alias("cost"), "hops", *(["nodes"] if nodes else []))


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, node_id): the shortest span of the same file that holds the line; ties to the smallest stable_id."""
    rows = points.join(spans, ["repo_id", "file_path"]).filter("line between line_start and line_end")
    w = Window.partitionBy("key").orderBy(F.col("line_end") - F.col("line_start"), "stable_id")
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").select("key", "node_id")


def _louvain(nodes: list[str], weights: dict[tuple[int, int], float], gamma: float) -> list[int]:
    """Labels after multi-level local moving in a fixed order; ties to the smallest label."""
    label = list(range(len(nodes)))
    members = [[i] for i in range(len(nodes))]
    w = {k: v for k, v in sorted(weights.items()) if k[0] != k[1]}
    loops: dict[int, float] = defaultdict(float)
    for _ in range(32):
        n = len(members)
        near: list[dict[int, float]] = [{} for _ in range(n)]
        for (a, b), x in w.items():
            near[a][b] = near[a].get(b, 0.0) + x
            near[b][a] = near[b].get(a, 0.0) + x
        degree = [sum(near[i].values()) + 2 * loops[i] for i in range(n)]
        m2 = sum(degree)
        if m2 <= 0:
            break
        at = list(range(n))
        total = degree[:]
        moved_any = False
        for _ in range(64):
            moved = False
            for i in range(n):
                links: dict[int, float] = defaultdict(float)
                for k, x in near[i].items():
                    links[at[k]] += x
                own = at[i]
                total[own] -= degree[i]
                best, gain = own, links.get(own, 0.0) - gamma * total[own] * degree[i] / m2
                for c in sorted(links):
                    g = links[c] - gamma * total[c] * degree[i] / m2
                    if g > gain + 1e-12 or abs(g - gain) <= 1e-12 and c < best:
                        best, gain = c, g
                total[best] += degree[i]
                if best != own:
                    at[i], moved, moved_any = best, True, True
            if not moved:
                break
        if not moved_any:
            break
        names: dict[int, int] = {}
        for c in at:
            names.setdefault(c, len(names))
        nxt: list[list[int]] = [[] for _ in names]
        for i, c in enumerate(at):
            nxt[names[c]] += members[i]
        new_loops: dict[int, float] = defaultdict(float)
        new_w: dict[tuple[int, int], float] = defaultdict(float)
        for i in range(n):
            new_loops[names[at[i]]] += loops[i]
        for (a, b), x in w.items():
            c, d = names[at[a]], names[at[b]]
            if c == d:
                new_loops[c] += x
            else:
                new_w[min(c, d), max(c, d)] += x
        members, loops, w = nxt, new_loops, dict(sorted(new_w.items()))
    for c, rows in enumerate(members):
        for i in rows:
            label[i] = c
    return label


def louvain(pairs: DataFrame, nodes: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(repo_id, node_id, label): the communities of each repository; label is its smallest stable_id.

    A repository is one task, as its moves are sequential; repositories run in parallel.
    """
    key = nodes.select("node_id", "stable_id")
    named = pairs.join(key.select(F.col("node_id").alias("a"), F.col("stable_id").alias("sa")), "a").join(key.select(F.col("node_id").alias("b"), F.col("stable_id").alias("sb")), "b")

    def run(b: pd.DataFrame) -> pd.DataFrame:
        ids = dict(zip(b.sa, b.a)) | dict(zip(b.sb, b.b))
        order = sorted(ids)
        place = {s: i for i, s in enumerate(order)}
        weights: dict[tuple[int, int], float] = defaultdict(float)
        for x, y, w in sorted(zip(b.sa, b.sb, b.weight)):
            i, j = place[x], place[y]
            weights[min(i, j), max(i, j)] += w
        label = _louvain(order, weights, gamma)
        first: dict[int, str] = {}
        for s, c in zip(order, label):
            first.setdefault(c, s)
        return pd.DataFrame({"repo_id": b.repo_id.iloc[0], "node_id": [ids[s] for s in order], "label": [first[c] for c in label]})

    return named.groupBy("repo_id").applyInPandas(run, "repo_id string, node_id string, label string")


def reading_order(items: DataFrame, links: DataFrame) -> DataFrame:
    """(plan, item, place): dependencies first, ready items by priority, cycles broken by priority.

    A plan is a short list (a change plan's communities), so each is one group.
    """

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame([], columns=["plan", "item", "place"])
        rank = dict(zip(a["item"], a["priority"]))
        need = {i: set() for i in rank}
        for x, y in zip(b["item"], b["needs"]):
            if x in need and y in need and x != y:
                need[x].add(y)
        out: list[str] = []
        heap = [(rank[i], i) for i in need if not need[i]]
        heapq.heapify(heap)
        left = set(need)
        while left:
            if heap:
                _, i = heapq.heappop(heap)
                if i not in left:
                    continue
            else:
                i = min(left, key=lambda k: (rank[k], k))
            left.discard(i)
            out.append(i)
            for k in sorted(left):
                if i in need[k]:
                    need[k].discard(i)
                    if not need[k]:
                        heapq.heappush(heap, (rank[k], k))
        return pd.DataFrame({"plan": a["plan"].iloc[0], "item": out, "place": range(1, len(out) + 1)})

    return items.groupBy("plan").cogroup(links.groupBy("plan")).applyInPandas(run, "plan string, item string, place int")


def cut_tree(files: DataFrame, most: int = 25) -> DataFrame:
    """(repo_id, path, folder): the shallowest folder above the file that holds at most ``most`` files; files that
    lie loose in a larger folder belong to it."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i - 1), "/"))
    above = files.select("repo_id", "path", F.posexplode(folders).alias("depth", "folder"))
    sizes = above.groupBy("repo_id", "folder").agg(F.count(F.lit(1)).alias("n"))
    rows = above.join(sizes, ["repo_id", "folder"])
    small = F.min(F.when(F.col("n") <= most, F.struct("depth", "folder")))
    return rows.groupBy("repo_id", "path").agg(F.coalesce(small["folder"], F.max(F.struct("depth", "folder"))["folder"]).alias("folder"))


def package_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo_id, path, root): the longest root that is a folder above the file."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i - 1), "/"))
    above = files.select("repo_id", "path", F.explode(folders).alias("root"))
    return above.join(roots.select("repo_id", "root").distinct(), ["repo_id", "root"]).groupBy("repo_id", "path").agg(F.max_by("root", F.length("root")).alias("root"))
