"""Vectors with more partners than a beam holds, over several shards and in one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgraph.llm import ann

VEC = "embedding_id string, chunk_id string, provider string, model_id string, dimensions int, embedding array<float>"


def table(spark, x):
    return spark.createDataFrame([(f"e{i:04d}", f"c{i:04d}", "p", "m", x.shape[1], [float(v) for v in r]) for i, r in enumerate(x)], VEC)


def cosines(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    return s


def named(vectors, members, least=0.9):
    """Pairs of chunks found, classes named by a chunk (all vectors differ)."""
    name = dict(members.collect())
    return {tuple(sorted((name[r.a], name[r.b]))) for r in ann.neighbours(vectors, least).collect()}, {name[r.class_id]: (r.cell, r.sub) for r in vectors.select("class_id", "cell", "sub").collect()}


def brute(x, ids="c"):
    s = cosines(x)
    return {(f"{ids}{i:04d}", f"{ids}{j:04d}") for i, j in zip(*np.nonzero(s >= 0.9)) if i < j}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_hub_is_found_by_its_partners_in_every_shard(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(900, 32)).astype(np.float32)
    for i in range(1, 181):
        side = np.r_[0, rng.normal(size=31)]
        x[i] = 0.93 * np.eye(32)[0] + np.sqrt(1 - 0.93**2) * side / np.linalg.norm(side)
    x[0] = np.eye(32)[0]
    found, at = named(*ann.classes(table(spark, x), shard=100))
    assert len(set(at.values())) >= 8
    assert len({at[f"c{i:04d}"] for i in range(181)}) > 1  # the hub's partners lie in several shards
    missed = [i for i in range(1, 181) if ("c0000", f"c{i:04d}") not in found]
    assert len(missed) <= 1


def test_near_pairs_across_shards(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 48))
    x[1500:] = x[:1500] / np.linalg.norm(x[:1500], axis=1, keepdims=True) + rng.uniform(0.02, 0.06, (1500, 1)) * rng.normal(size=(1500, 48))
    x = x.astype(np.float32)
    found, at = named(*ann.classes(table(spark, x), shard=200))
    want = brute(x)
    assert sum(at[a] != at[b] for a, b in want) > 100
    assert len(want - found) <= 0.01 * len(want)
    assert found <= want


def test_shard_too_large_is_split_and_searched_whole(spark):
    rng = np.random.default_rng(9)
    x = (np.eye(16)[0] * 3 + rng.normal(size=(700, 16))).astype(np.float32)
    vectors, members = ann.classes(table(spark, x), shard=700)
    split = vectors.withColumns({"subs": F.lit(4), "sub": F.pmod(F.xxhash64("class_id"), F.lit(4)).cast("int")})
    found, _ = named(split, members)
    s = cosines(x)
    five = np.sort(s, axis=1)[:, -5]
    want = {(f"c{i:04d}", f"c{j:04d}") for i, j in zip(*np.nonzero((s >= 0.9) & ((s >= five[:, None]) | (s >= five[None, :])))) if i < j}
    assert len(want - found) <= 0.01 * len(want)


def test_copies_of_a_large_class(spark, monkeypatch):
    monkeypatch.setattr(ann, "EXPAND", 3)
    x = np.ones((10, 4), np.float32)
    got = {tuple(r) for r in ann.similar_pairs(table(spark, x)).collect()}
    assert got == {(f"c{i:04d}", f"c{j:04d}") for i in range(3) for j in range(10) if i < j}
    rows = ann.copies(table(spark, x)).collect()
    assert len(rows) == 10 and {(r.first_chunk_id, r.copies) for r in rows} == {("c0000", 10)}


def test_more_queries_than_a_slot(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    x[600:] = x[:600] + 0.2 * rng.normal(size=(600, 16)).astype(np.float32)
    vectors, members = ann.classes(table(spark, x), shard=100)
    whole, _ = named(vectors, members)
    monkeypatch.setattr(ann, "SLOT", 16)
    parts, _ = named(vectors, members)
    assert parts == whole and len(brute(x) - whole) <= 0.01 * len(brute(x))


def test_hot_group_of_one_direction(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 16))
    x[:150] = x[0] * rng.uniform(0.5, 2, 150)[:, None]  # ties at 1.0, not byte-equal
    x[150:300] = x[150] + 0.1 * rng.normal(size=(150, 16))  # all near, none tied
    x = rng.permutation(x).astype(np.float32)
    s = cosines(x)
    five = np.sort(s, axis=1)[:, -5]
    want = {(f"c{i:04d}", f"c{j:04d}") for i, j in zip(*np.nonzero((s >= 0.9) & ((s >= five[:, None]) | (s >= five[None, :])))) if i < j}
    assert len(want) > 150 * 149 // 2
    assert {tuple(r) for r in ann.similar_pairs(table(spark, x)).collect()} == want
