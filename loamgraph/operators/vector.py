"""Exact vector retrieval in double precision, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import layers as L
from ..functions.text import words


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """0 where a vector has no length."""
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def top_k(vectors: DataFrame, key: str, query: list[float], k: int) -> DataFrame:
    """The k most similar vectors to one query: a literal, so no join; a heap of k per partition."""
    q = F.array(*[F.lit(float(x)) for x in query])
    size = sum(x * x for x in query) ** 0.5
    v = F.col("embedding")
    return vectors.select(key, F.round(cosine(v, q, norm(v), F.lit(size)), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def best_to_seeds(vectors: DataFrame, key: str, seeds: list[tuple[str, list[float]]], least: float) -> DataFrame:
    """Best similarity of every vector that is no seed to any of a bounded list of seeds (at most 256)."""
    if len(seeds) > 256:
        raise ValueError("seeds are a short list; use the approximate index for more")
    v, n = F.col("embedding"), norm(F.col("embedding"))
    scores = []
    for _, q in seeds:
        lit = F.array(*[F.lit(float(x)) for x in q])
        scores.append(cosine(v, lit, n, F.lit(sum(x * x for x in q) ** 0.5)))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return vectors.filter(~F.col(key).isin(*[i for i, _ in seeds])).select(key, F.round(best, 6).alias("best")).filter(F.col("best") >= least)


def pairwise(vectors: DataFrame, key: str, group: list[str]) -> DataFrame:
    """Cosine of all pairs within small groups, as the chunks of one file."""
    v = vectors.select(*group, key, "embedding", norm(F.col("embedding")).alias("n"))
    a = v.select(*group, F.col(key).alias("a"), F.col("embedding").alias("va"), F.col("n").alias("na"))
    b = v.select(*group, F.col(key).alias("b"), F.col("embedding").alias("vb"), F.col("n").alias("nb"))
    return a.join(b, group).filter("a < b").select("a", "b", F.round(cosine(F.col("va"), F.col("vb"), F.col("na"), F.col("nb")), 6).alias("score"))


def centroid(vectors: DataFrame, group: str) -> DataFrame:
    """Mean vector per group, element by element, so that every partition sums what it has."""
    parts = vectors.select(group, F.posexplode("embedding").alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("embedding"))


def routed_layers(scores: DataFrame, floor: float = 0.65, margin: float = 0.06) -> DataFrame:
    """(query, layer, score) of layers at the floor or above, within the margin of the query's best."""
    pooled = scores.groupBy("query", "layer").agg(F.max("score").alias("score"))
    top = F.max("score").over(Window.partitionBy("query"))
    return pooled.withColumn("top", top).filter((F.col("top") >= floor) & (F.col("score") >= floor) & (F.col("score") >= F.col("top") - margin)).select("query", "layer", "score", L.rank(F.col("layer")).alias("rank"))


def invalid(vectors: DataFrame) -> DataFrame:
    """(embedding_id, reason) of vectors that must not be used."""
    v = F.col("embedding")
    reason = (
        F.when(v.isNull(), "null")
        .when(F.size(v) != F.col("dimensions"), "size")
        .when(F.exists(v, lambda e: F.isnan(e) | (F.abs(e) == float("inf"))), "not finite")
        .when(F.forall(v, lambda e: e == 0), "zero")
    )
    return vectors.select("embedding_id", reason.alias("reason")).filter("reason is not null").distinct()


__all__ = ["best_to_seeds", "centroid", "cosine", "dot", "invalid", "norm", "pairwise", "routed_layers", "top_k", "words"]


def literal(vector: Column, places: int = 3) -> Column:
    """The vector as text, numbers that are not finite as 0."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    one = lambda x: F.when(good(x), F.round(x.cast("double"), places)).otherwise(0.0).cast(f"decimal(12,{places})").cast("string")
    return F.concat(F.lit("["), F.array_join(F.transform(vector, one), ","), F.lit("]"))


def neighbours_of_seeds(vectors: DataFrame, seeds: DataFrame, key: str, least: float, block: int = 8192, seed_block: int = 4096) -> DataFrame:
    """(key, best): best similarity of every vector that is no seed to any seed, where it is at least ``least``.

    Both sides are hashed into blocks of bounded size; a pair of blocks is one matrix product in one task, and the best of
    each vector over the seeds' blocks is a partial maximum.  Every seed meets every vector, once.
    """
    import numpy as np
    import pyarrow as pa

    n, m = vectors.count(), seeds.count()
    rows, cols = max(1, -(-n // block)), max(1, -(-m // seed_block))
    at = lambda df, k: F.pmod(F.xxhash64(key), F.lit(k)).cast("int")
    own = seeds.select(key).distinct()
    left = vectors.join(own, key, "left_anti").select(key, "embedding", at(vectors, rows).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("j"))
    right = seeds.select(F.col("embedding").alias("s_embedding"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("s_i"), at(seeds, cols).alias("s_j"))
    kind = vectors.schema[key].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64()

    def unit(column):
        a = column.combine_chunks()
        x = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    def run(group: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], arrow), pa.array([], pa.float64())], names=[key, "best"])
        x, q = unit(a["embedding"]), unit(b["s_embedding"])
        best = np.concatenate([(x[k : k + 1024] @ q.T).max(1) for k in range(0, len(x), 1024)])
        return pa.table([a[key].combine_chunks().cast(arrow), pa.array(best)], names=[key, "best"])

    pairs = left.groupBy("i", "j").cogroup(right.groupBy("s_i", "s_j")).applyInArrow(run, f"{key} {kind}, best double")
    return pairs.groupBy(key).agg(F.round(F.max("best"), 6).alias("best")).filter(F.col("best") >= least)
