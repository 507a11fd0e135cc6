"""Problem 1: the most similar vectors for every vector.

Pivots are fitted per model to a bounded sample (``PER_PIVOT`` vectors a pivot, ``SAMPLE`` at most; two-level k-means); a vector belongs to the shard of
its nearest pivot, so a shard holds about ``SHARD`` vectors and near vectors mostly share one.  Each shard builds a
hierarchical navigable small-world graph, kept as flat neighbour arrays (one int32 matrix per layer) and written once to
the shared folder.  A vector is searched in its own shard (its insertion is that search) and in every shard whose
dividing plane it is near: within ``SIGMAS`` standard deviations of where a partner can lie across the plane, at most
``ROUTES`` shards.  Query blocks travel to the graphs; a graph is copied only once per ``SLOT`` queries.  The shards'
results are merged.  Building inserts in batches and searching advances many queries at once, so both are matrix
operations.

Exact copies of a vector are one class: the graph holds it once, and its members are joined back at the end.
Cosines are recomputed in double precision from the given floats before any comparison.

Accuracy: approximate search and routing; recall against brute force is measured in tests and in the README.  A beam
that comes back full of partners is followed by an exact comparison with the whole shard.

Defined results: a vector that is null, of another size than ``dimensions``, zero, or not finite is left out, as are
null ids; repeated rows count once; equal cosines (to 12 digits) share a rank, so all of them are among the five
highest; of two copies (or members of two linked classes) a pair is given if either is one of the first ``EXPAND``
members of its class, so a class of any size gives rows in proportion to it, and ``copies`` names all members; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Vectors of a shard, about; a shard of more than twice as many is split by hash and all its parts are searched.
SHARD = 4_096
#: Pivots are held by the driver and by every task that routes: at most so many per model; beyond, shards grow.
MOST_SHARDS = 65_536
#: Vectors per pivot, and most per model, to which the pivots are fitted.
PER_PIVOT = 256
SAMPLE = 131_072
#: Width of the zone beside a dividing plane from which the neighbouring shard is searched; most shards so searched.
SIGMAS = 2.5
SIGMAS_NEAREST = 2.0
ROUTES = 32
#: Queries of one shard that one task searches.
SLOT = 16_384
M = 10
EF_BUILD = 16
EF_SEARCH = 12
#: The same for the nearest of all, where partners don't stand out.
M_NEAREST = 16
EF_NEAREST = 48
#: Members of a class that are paired with all others.
EXPAND = 64
TOP = 5
MODEL = ["provider", "model_id", "dimensions"]


# -- the graph -----------------------------------------------------------------------------------------------
def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def levels_of(ids: np.ndarray, m: int = M) -> np.ndarray:
    """Layer of every node, geometric with ratio 1/m, from a hash of its id."""
    h = pd.util.hash_array(ids.astype(object), categorize=False) if ids.dtype == object else pd.util.hash_array(ids)
    u = (h.astype(np.float64) + 1.0) / 2.0**64
    return np.minimum((-np.log(u) / np.log(m)).astype(np.int64), 12)


def beam(x: np.ndarray, graph: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, wide: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Best ``ef`` nodes of the layer for every query: (ids, similarities), -1 where there are none."""
    n, ef = len(q), max(ef, entry.shape[1])
    ids = np.full((n, ef), -1, np.int32)
    sim = np.full((n, ef), -np.inf, np.float32)
    done = np.zeros((n, ef), bool)
    k = entry.shape[1]
    ids[:, :k] = entry
    e = np.maximum(entry, 0)
    sim[:, :k] = np.where(entry >= 0, np.einsum("nkd,nd->nk", x[e], q), -np.inf)
    active = np.arange(n)
    width = graph.shape[1]
    while len(active):
        s = np.where(done[active] | (ids[active] < 0), -np.inf, sim[active])
        pick = np.argpartition(-s, min(wide, ef - 1), axis=1)[:, :wide] if ef > wide else np.argsort(-s, axis=1)[:, :wide]
        best = np.take_along_axis(s, pick, 1)
        alive = np.isfinite(best).any(1)
        active, pick, best = active[alive], pick[alive], best[alive]
        if not len(active):
            break
        row = np.arange(len(active))[:, None]
        chosen = np.where(np.isfinite(best), ids[active][row, pick], -1)
        flags = done[active]
        flags[row, pick] = True
        done[active] = flags
        near = np.where(chosen[:, :, None] >= 0, graph.take(np.maximum(chosen, 0), axis=0), -1).reshape(len(active), wide * width)
        safe = np.maximum(near, 0)
        value = np.einsum("nkd,nd->nk", x.take(safe, axis=0), q[active])
        worst = sim[active].min(1, keepdims=True)
        value[(near < 0) | (value <= worst)] = -np.inf
        # only what would enter the beam is compared with it
        keep = min(value.shape[1], ef)
        if keep < value.shape[1]:
            part = np.argpartition(-value, keep - 1, axis=1)[:, :keep]
            near, value = np.take_along_axis(near, part, 1), np.take_along_axis(value, part, 1)
        order = np.argsort(near, axis=1, kind="stable")
        near, value = np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)
        value[:, 1:][near[:, 1:] == near[:, :-1]] = -np.inf
        value[(near[:, :, None] == ids[active][:, None, :]).any(2)] = -np.inf
        all_sim = np.concatenate([sim[active], value], 1)
        all_ids = np.concatenate([ids[active], near], 1)
        all_done = np.concatenate([done[active], np.zeros_like(near, bool)], 1)
        top = np.argpartition(-all_sim, ef - 1, axis=1)[:, :ef]
        sim[active] = np.take_along_axis(all_sim, top, 1)
        ids[active] = np.where(np.isfinite(sim[active]), np.take_along_axis(all_ids, top, 1), -1)
        done[active] = np.take_along_axis(all_done, top, 1)
    return ids, sim


def select(x: np.ndarray, q: np.ndarray, cand: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
    """Diverse neighbours: a candidate is kept if it is nearer to the node than to any kept one; gaps are filled."""
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    n, c = cand.shape
    v = x.take(np.maximum(cand, 0), axis=0)
    cross = np.matmul(v, v.transpose(0, 2, 1))
    kept = np.zeros((n, c), bool)
    count = np.zeros(n, np.int64)
    for i in range(c):
        near = np.where(kept, cross[:, i, :], -np.inf).max(1)
        ok = np.isfinite(sim[:, i]) & (cand[:, i] >= 0) & (count < m) & (sim[:, i] > near)
        kept[:, i] = ok
        count += ok
    rank = np.where(kept, 0, np.where(np.isfinite(sim) & (cand >= 0), 1, 2)) * c + np.arange(c)
    first = np.argsort(rank, axis=1)[:, :m]
    out = np.take_along_axis(cand, first, 1)
    valid = np.take_along_axis(np.isfinite(sim) & (cand >= 0), first, 1)
    out = np.where(valid, out, -1)
    return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1) if out.shape[1] < m else out


def build(x: np.ndarray, level: np.ndarray, m: int = M, ef: int = EF_BUILD, least: float | None = None, top: int = TOP) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(order, layers, pairs): nodes sorted by layer, highest first; layers[l] is the neighbour matrix of the first
    rows, those on layer l or above, in positions of that order; pairs are the positions of nodes as similar as
    ``least``, as the insertions met them.  A node whose insertion met partners only is compared with all nodes, as
    others may have been left out."""
    met: list[np.ndarray] = []
    crowded: list[np.ndarray] = []
    order = np.argsort(-level, kind="stable")
    x = x[order]
    level = level[order]
    highest = int(level.max()) if len(level) else 0
    layers: list[np.ndarray] = [None] * (highest + 1)
    for lv in range(highest, -1, -1):
        n = int((level >= lv).sum())
        width = 2 * m if lv == 0 else m
        graph = np.full((n, width), -1, np.int32)
        done = min(n, 128)
        report = met if lv == 0 and least is not None else None
        _link(x, graph, np.arange(done), np.full((done, 1), -1, np.int32), np.full((done, 1), -np.inf, np.float32), m, width, least, report, top)
        while done < n:
            new = np.arange(done, min(n, done + min(2048, max(128, done))))
            entry = descend(x, layers, x[new], lv + 1, done)
            cand, sim = beam(x, graph[:done], x[new], entry, ef)
            if report is not None:
                crowded.append(new[sim.min(1) >= least - 1e-3])
            _link(x, graph, new, cand, sim, m, width, least, report, top)
            done += len(new)
        layers[lv] = graph
    if crowded and len(full := np.concatenate(crowded)):
        r, c = partners(x, x[full], least, top)
        met.append(np.stack([full[r], c], 1)[full[r] != c])
    return order, layers, np.concatenate(met) if met else np.empty((0, 2), np.int64)


def descend(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, down_to: int, limit: int) -> np.ndarray:
    """Entry points for the layer below ``down_to``."""
    seeds = min(limit, 64)
    first = q @ x[:seeds].T
    entry = np.argpartition(-first, min(3, seeds - 1), axis=1)[:, : min(4, seeds)].astype(np.int32)
    for lv in range(len(layers) - 1, down_to - 1, -1):
        if layers[lv] is None:
            continue
        ids, sim = beam(x, layers[lv], q, np.where(entry < len(layers[lv]), entry, 0), 8)
        best = np.argsort(-sim, axis=1)[:, :4]
        entry = np.take_along_axis(ids, best, 1)
        entry[:, 0] = np.maximum(entry[:, 0], 0)
    # while a layer is being built, the layer above may know nodes that this one does not have yet
    entry = np.where(entry < limit, entry, -1)
    entry[:, -1] = np.where(entry.max(1) < 0, first.argmax(1), entry[:, -1])
    # an entry twice in a beam would be expanded twice
    entry = np.sort(entry, axis=1)
    entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = -1
    return entry


def _link(x: np.ndarray, graph: np.ndarray, new: np.ndarray, cand: np.ndarray, sim: np.ndarray, m: int, width: int, least: float | None = None, met: list | None = None, top: int = TOP) -> None:
    """Connect a batch: candidates of the search and the batch itself; then the reverse edges."""
    own = x[new] @ x[new].T
    np.fill_diagonal(own, -np.inf)
    if met is not None:
        r, c = np.nonzero((cand >= 0) & (sim >= least - 1e-3))
        met.append(np.stack([new[r], cand[r, c].astype(np.int64)], 1))
        # of the batch itself only what can be among the highest of one of the two
        k = min(top + 1, len(new))
        last = np.maximum(least - 1e-3, np.partition(own, len(new) - k, axis=1)[:, len(new) - k] - 1e-5)
        r, c = np.nonzero(own >= last[:, None])
        met.append(np.stack([new[r], new[c]], 1))
    k = min(m, len(new) - 1)
    if k > 0:
        part = np.argpartition(-own, k - 1, axis=1)[:, :k]
        cand = np.concatenate([cand, new[part].astype(np.int32)], 1)
        sim = np.concatenate([sim, np.take_along_axis(own, part, 1)], 1)
    out = select(x, x[new], cand, sim, m)
    graph[new, :m] = out
    src = np.repeat(new, m)
    dst = out.reshape(-1)
    ok = dst >= 0
    src, dst = src[ok], dst[ok]
    if not len(dst):
        return
    s = np.einsum("nd,nd->n", x[src], x[dst])
    o = np.lexsort((-s, dst))
    src, dst, s = src[o], dst[o], s[o]
    start = np.r_[0, np.flatnonzero(np.diff(dst)) + 1]
    place = np.arange(len(dst)) - np.repeat(start, np.diff(np.r_[start, len(dst)]))
    nodes = dst[start]
    extra = np.full((len(nodes), width), -1, np.int32)
    fits = place < width
    extra[np.searchsorted(nodes, dst[fits]), place[fits]] = src[fits]
    for a in range(0, len(nodes), 2048):
        v = nodes[a : a + 2048]
        both = np.concatenate([graph[v], extra[a : a + 2048]], 1)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        val = np.where(both >= 0, np.einsum("nkd,nd->nk", x[np.maximum(both, 0)], x[v]), -np.inf)
        full = (both >= 0).sum(1)
        roomy = full <= width
        if roomy.any():
            b = np.sort(both[roomy], axis=1)[:, ::-1][:, :width]
            graph[v[roomy]] = b
        if (~roomy).any():
            w = ~roomy
            graph[v[w]] = select(x, x[v[w]], both[w], val[w], width)


def search(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, ef: int = EF_SEARCH) -> tuple[np.ndarray, np.ndarray]:
    """Positions and similarities of the best ``ef`` nodes for each query."""
    if not len(x):
        return np.full((len(q), ef), -1, np.int32), np.full((len(q), ef), -np.inf, np.float32)
    return beam(x, layers[0], q, descend(x, layers, q, 1, len(x)), ef)


def partners(x: np.ndarray, q: np.ndarray, least: float, top: int, size: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) by products with all nodes: those as similar as ``least`` where one can be among the ``top`` highest
    of the other, ties included.  One place more is kept, as a query may itself be a node; what is left out has ``top``
    nearer ones on both sides and so no place whatever the other shards hold."""
    rs, fs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a in range(0, len(q), size):
        sim = q[a : a + size] @ x.T
        # single precision: the margin is far above its error
        line = lambda axis, n: np.partition(sim, max(0, n - top - 1), axis=axis).take([max(0, n - top - 1)], axis=axis) - 1e-5  # noqa: B023, E731
        r, f = np.nonzero((sim >= least - 1e-3) & ((sim >= line(1, len(x))) | (sim >= line(0, len(sim)))))
        rs.append(r + a)
        fs.append(f)
    return np.concatenate(rs), np.concatenate(fs)


# -- Spark -----------------------------------------------------------------------------------------------------
def usable(embeddings: DataFrame) -> DataFrame:
    """(provider, model_id, dimensions, embedding_id, chunk_id, embedding) of usable vectors."""
    v = F.col("embedding")
    # NaN is the greatest of all numbers, so the greatest and the least tell whether all are finite, and whether any is not 0
    top, low = F.array_max(v), F.array_min(v)
    finite = ~F.isnan(top) & (top < float("inf")) & (low > float("-inf")) & ((top != 0) | (low != 0))
    whole = (F.size(v) == F.col("dimensions")) & finite & F.forall(v, lambda e: e.isNotNull())
    return embeddings.select(*MODEL, "embedding_id", "chunk_id", "embedding").filter(
        "chunk_id is not null and embedding_id is not null and provider is not null and model_id is not null and embedding is not null"
    ).filter(whole)


def keyed(embeddings: DataFrame) -> DataFrame:
    """Usable rows with the id of their vector's class: 128 bits of hash of model and vector."""
    k = lambda n: F.hex(F.xxhash64(F.lit(n), *MODEL, "embedding"))
    return usable(embeddings).select(*MODEL, F.concat_ws("-", k(3), k(11)).alias("class_id"), "chunk_id", "embedding")


def membership(embeddings: DataFrame) -> DataFrame:
    """(class_id, chunk_id), one row each."""
    return keyed(embeddings).select("class_id", "chunk_id").distinct()


def _centres(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Unit centres of k-means by cosine; a centre without members stays where it was."""
    at = x[:k].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[a : a + 4096] @ at.T).argmax(1) for a in range(0, len(x), 4096)])
        o = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(own[o]) > 0])
        total = np.add.reduceat(x[o], first, axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        who = own[o][first]
        at[who] = np.where(norm > 1e-6, total / np.maximum(norm, 1e-6), at[who])
    return at


def fit(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coarse, pivots, start): about k pivots in two levels; those below coarse centre i are pivots[start[i]:start[i+1]]."""
    coarse = _centres(x, min(len(x), max(1, round(k**0.5))))
    own = np.concatenate([(x[a : a + 4096] @ coarse.T).argmax(1) for a in range(0, len(x), 4096)])
    parts, start = [], [0]
    for i in range(len(coarse)):
        part = x[own == i]
        parts.append(_centres(part, min(len(part), max(1, round(k * len(part) / len(x))))) if len(part) else coarse[i : i + 1])
        start.append(start[-1] + len(parts[-1]))
    return coarse, np.concatenate(parts), np.asarray(start)


def route(x: np.ndarray, coarse: np.ndarray, pivots: np.ndarray, start: np.ndarray, most: int = ROUTES, wide: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(cells, distances) per vector: the nearest pivot first, then others by the distance of the vector from the plane
    that divides the two cells (0 for the own one, infinite where there is none).  Pivots below the ``wide`` nearest
    coarse centres are looked at."""
    n, wide = len(x), min(wide, len(coarse))
    width = int(np.diff(start).max())
    up = np.argpartition(-(x @ coarse.T), wide - 1, axis=1)[:, :wide]
    score = np.full((n, wide, width), -np.inf, np.float32)
    cell = np.full((n, wide, width), -1, np.int32)
    for i in range(len(coarse)):
        r, place = np.nonzero(up == i)
        if len(r):
            m = start[i + 1] - start[i]
            score[r, place, :m] = x[r] @ pivots[start[i] : start[i + 1]].T
            cell[r, place, :m] = np.arange(start[i], start[i + 1])
    score, cell = score.reshape(n, -1), cell.reshape(n, -1)
    k = min(2 * most, score.shape[1])
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    score, cell = np.take_along_axis(score, best, 1), np.take_along_axis(cell, best, 1)
    row = np.arange(n)
    lead = score.argmax(1)
    own = cell[row, lead]
    apart = np.sqrt(np.maximum(2 - 2 * np.einsum("nkd,nd->nk", pivots[np.maximum(cell, 0)], pivots[own]), 1e-9))
    far = np.where(cell >= 0, (score[row, lead][:, None] - score) / apart, np.inf).astype(np.float32)
    far[row, lead] = -1
    order = np.argsort(far, axis=1, kind="stable")[:, : most + 1]
    far, cell = np.take_along_axis(far, order, 1), np.take_along_axis(cell, order, 1)
    return cell, np.maximum(far, 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors of an Arrow column of lists, all of one length."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(a), -1)


_ROUTED = "provider string, model_id string, dimensions int, class_id string, embedding array<float>, cell int, routes array<int>, far array<float>"


def routed(rows: DataFrame, about: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per different vector of a model, with the cell of its nearest pivot and the cells beside it."""
    spark = rows.sparkSession
    # one row per model; the number of different vectors is only needed about
    sizes = {(r.provider, r.model_id, r.dimensions): max(1, r.n) for r in about.groupBy(*MODEL).agg(F.approx_count_distinct(F.xxhash64("embedding"), 0.02).alias("n")).collect()}
    cells = {m: max(1, min(MOST_SHARDS, -(-n // shard))) for m, n in sizes.items()}
    if not sizes:
        return spark.createDataFrame([], _ROUTED)
    share = spark.createDataFrame([(*m, min(1.0, min(SAMPLE, PER_PIVOT * cells[m]) / n)) for m, n in sizes.items()], "provider string, model_id string, dimensions int, share double")
    h = F.xxhash64(F.lit(5), F.col("class_id"))
    in_sample = F.shiftrightunsigned(h, 11) / float(2**53) < F.col("share")
    sample = rows.join(F.broadcast(share), MODEL).filter(in_sample).groupBy(*MODEL, "class_id").agg(F.first("embedding").alias("embedding"))
    distinct = rows.groupBy(*MODEL, "class_id").agg(F.first("embedding").alias("embedding"))

    def learn(key: tuple, t: pa.Table) -> pa.Table:
        model = tuple(k.as_py() for k in key)
        t = t.sort_by("class_id")
        x = _unit(_matrix(t["embedding"]))
        # in an order that has nothing to do with the ids
        coarse, pivots, start = fit(x[np.random.default_rng(len(x)).permutation(len(x))], cells[model])
        row = [*model, coarse.tobytes(), pivots.tobytes(), start.astype(np.int64).tobytes()]
        return pa.table([[v] for v in row], schema=pa.schema([("provider", pa.string()), ("model_id", pa.string()), ("dimensions", pa.int32()), ("coarse", pa.binary()), ("pivots", pa.binary()), ("start", pa.binary())]))

    # at most MOST_SHARDS pivots per model: 16 MB at 64 dimensions
    learnt = sample.groupBy(*MODEL).applyInArrow(learn, "provider string, model_id string, dimensions int, coarse binary, pivots binary, start binary").collect()
    model_of = {
        (r.provider, r.model_id, r.dimensions): (np.frombuffer(r.coarse, np.float32).reshape(-1, r.dimensions), np.frombuffer(r.pivots, np.float32).reshape(-1, r.dimensions), np.frombuffer(r.start, np.int64)) for r in learnt
    }

    def send(batches):
        for b in batches:
            key = list(zip(b["provider"].to_pylist(), b["model_id"].to_pylist(), b["dimensions"].to_pylist()))
            cell = np.zeros(len(key), np.int32)
            beside: list = [[]] * len(key)
            far: list = [[]] * len(key)
            for m in set(key):
                rows = np.flatnonzero([k == m for k in key])
                if m not in model_of:  # too few vectors for the sample to hold one
                    continue
                for a in range(0, len(rows), 1024):
                    r = rows[a : a + 1024]
                    c, f = route(_unit(_matrix(b["embedding"].take(pa.array(r)))), *model_of[m])
                    cell[r] = c[:, 0]
                    keep = np.isfinite(f)
                    for i, j in enumerate(r):
                        beside[j], far[j] = c[i, 1:][keep[i, 1:]], f[i, 1:][keep[i, 1:]]
            yield pa.RecordBatch.from_arrays(
                [*(b[c] for c in (*MODEL, "class_id", "embedding")), pa.array(cell), pa.array(beside, pa.list_(pa.int32())), pa.array(far, pa.list_(pa.float32()))],
                names=[*MODEL, "class_id", "embedding", "cell", "routes", "far"],
            )

    return stored(distinct.mapInArrow(send, _ROUTED), "routed")


def classes(embeddings: DataFrame, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors with their shard (cell, sub) and the cells beside it, and (class_id, chunk_id) of all members."""
    v = routed(keyed(embeddings), embeddings.filter("embedding is not null"), shard)
    # at most MOST_SHARDS rows per model
    parts = v.groupBy(*MODEL, "cell").agg(F.ceil(F.count(F.lit(1)) / (2 * shard)).cast("int").alias("subs"))
    v = v.join(F.broadcast(parts), [*MODEL, "cell"])
    return v.withColumn("sub", F.pmod(F.xxhash64("class_id", F.lit(1)), F.col("subs")).cast("int")), membership(embeddings)


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision from the given floats."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    return np.einsum("nd,nd->n", x, y) / np.sqrt(np.einsum("nd,nd->n", x, x) * np.einsum("nd,nd->n", y, y))


SHARD_KEY = [*MODEL, "cell", "sub"]
_GRAPH = pa.schema(
    [("provider", pa.string()), ("model_id", pa.string()), ("dimensions", pa.int32()), ("cell", pa.int32()), ("sub", pa.int32()), ("ids", pa.list_(pa.string())), ("vectors", pa.binary()), ("layers", pa.list_(pa.binary())), ("widths", pa.list_(pa.int32())), ("a", pa.string()), ("b", pa.string()), ("cos", pa.float64())]
)
_GRAPH_SQL = "provider string, model_id string, dimensions int, cell int, sub int, ids array<string>, vectors binary, layers array<binary>, widths array<int>, a string, b string, cos double"
_PAIRS = pa.schema([("provider", pa.string()), ("model_id", pa.string()), ("a", pa.string()), ("b", pa.string()), ("cos", pa.float64())])
_PAIRS_SQL = "provider string, model_id string, a string, b string, cos double"


def _answers(x: np.ndarray, raw: np.ndarray, ids: np.ndarray, layers: list[np.ndarray], q: pa.Table, least: float | None, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cosine) of a block of queries searched in one graph."""
    qr, names = _matrix(q["q_embedding"]), q["q_class_id"].to_numpy()
    ef = EF_SEARCH if least is not None else EF_NEAREST
    parts = []
    for at in range(0, len(qr), 2048):
        block = _unit(qr[at : at + 2048])
        found, sim = search(x, layers, block, ef)
        if least is None:
            near = np.take_along_axis(found, np.argsort(-sim, axis=1)[:, : top + 2], 1)
            r, c = np.nonzero(near >= 0)
            f = near[r, c]
        else:
            r, c = np.nonzero((found >= 0) & (sim >= least - 1e-3))
            f = found[r, c]
            # a beam that is full of partners may have left others out
            full = np.flatnonzero((found >= 0).all(1) & (sim.min(1) >= least - 1e-3))
            if len(full):
                all_r, all_f = partners(x, block[full], least, top)
                part = ~np.isin(r, full)
                r, f = np.concatenate([r[part], full[all_r]]), np.concatenate([f[part], all_f])
        parts.append((r + at, f))
    r, f = (np.concatenate(p) for p in zip(*parts))
    cos = _exact(qr[r], raw[f])
    # without a bound for all, what is not as near as the fifth that a query has already is of no use to it
    ok = cos >= (least if least is not None else q["q_floor"].to_numpy()[r] - 1e-12)
    return names[r[ok]], ids[f[ok]], cos[ok]


def graphs(vectors: DataFrame, queries: DataFrame | None = None, least: float | None = None, top: int = TOP) -> DataFrame:
    """Per shard one row with ids, vectors and the layers' flat neighbour arrays; and rows (a, b, cos): with ``least`` the
    pairs of the shard at least so similar that the insertions met, else the ``top`` and two more nearest of each vector
    by a search in the finished graph; and what the given queries from other shards find."""
    m, ef = (M, EF_BUILD) if least is not None else (M_NEAREST, EF_NEAREST)

    def run(key: tuple, t: pa.Table, q: pa.Table | None = None) -> pa.Table:
        if not t.num_rows:
            return _GRAPH.empty_table()
        raw, ids = _matrix(t["embedding"]), t["class_id"].to_numpy()
        o = np.argsort(ids)
        raw, ids = raw[o], ids[o]
        order, layers, pairs = build(_unit(raw), levels_of(ids, m), m, ef, least, top)
        ids, raw = ids[order], raw[order]
        x = _unit(raw)
        if least is None:
            found = []
            for at in range(0, len(x), 2048):
                near, sim = search(x, layers, x[at : at + 2048], ef)
                near = np.take_along_axis(near, np.argsort(-sim, axis=1)[:, : top + 3], 1)
                r, c = np.nonzero(near >= 0)
                found.append(np.stack([r + at, near[r, c]], 1))
            pairs = np.concatenate(found)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        cos = _exact(raw[pairs[:, 0]], raw[pairs[:, 1]])
        ok = cos >= (least if least is not None else -2)
        a, b, cos = ids[pairs[ok, 0]], ids[pairs[ok, 1]], cos[ok]
        if least is None:
            # the top-th of each vector, as a row without a partner
            o = np.lexsort((-cos, pairs[ok, 0]))
            who = pairs[ok, 0][o]
            begin = np.searchsorted(who, np.arange(len(ids)))
            enough = np.flatnonzero(begin + top - 1 < np.searchsorted(who, np.arange(len(ids)), side="right"))
            a, b, cos = np.concatenate([a, ids[enough]]), np.concatenate([b, np.full(len(enough), None)]), np.concatenate([cos, cos[o][begin[enough] + top - 1]])
        if q is not None and q.num_rows:
            qa, qb, qc = _answers(x, raw, ids, layers, q, least, top)
            a, b, cos = np.concatenate([a, qa]), np.concatenate([b, qb]), np.concatenate([cos, qc])
        n = 1 + len(cos)
        own = [pa.array([k.as_py()] * n, f.type) for k, f in zip(key, _GRAPH)]
        one = lambda v, i: pa.array([v, *[None] * (n - 1)], _GRAPH.field(i).type)
        graph = [one(list(ids), 5), one(raw.tobytes(), 6), one([g.tobytes() for g in layers], 7), one([g.shape[1] for g in layers], 8)]
        return pa.table([*own, *graph, pa.array([None, *a], pa.string()), pa.array([None, *b], pa.string()), pa.array([None, *cos], pa.float64())], schema=_GRAPH)

    # a task for each shard, about: put together by size, a few tasks would do all the work
    n = max(1, min(vectors.select(*SHARD_KEY).distinct().count(), 16_384))
    spread = vectors.select(*SHARD_KEY, "class_id", "embedding").repartition(n, *SHARD_KEY).groupBy(*SHARD_KEY)
    if queries is None:
        return spread.applyInArrow(lambda key, t: run(key, t), _GRAPH_SQL)
    # other names, as both sides come from the same table
    asked = queries.select(*[F.col(c).alias(f"q_{c}") for c in (*SHARD_KEY, "class_id", "embedding")])
    q_key = [f"q_{c}" for c in SHARD_KEY]
    return spread.cogroup(asked.repartition(n, *q_key).groupBy(*q_key)).applyInArrow(lambda key, t, q: run(key, t, q), _GRAPH_SQL)


def searched(index: DataFrame, queries: DataFrame, slots: DataFrame, least: float | None, top: int) -> DataFrame:
    """(provider, model_id, a, b, cos) of queries in stored graphs; a graph is read once per slot of queries."""

    def run(key: tuple, g: pa.Table, q: pa.Table) -> pa.Table:
        if not g.num_rows or not q.num_rows:
            return _PAIRS.empty_table()
        ids = g["ids"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        raw = np.frombuffer(g["vectors"][0].as_py(), np.float32).reshape(len(ids), -1)
        layers = [np.frombuffer(x, np.int32).reshape(-1, w) for x, w in zip(g["layers"][0].as_py(), g["widths"][0].as_py())]
        a, b, cos = _answers(_unit(raw), raw, ids, layers, q, least, top)
        return pa.table([pa.array([key[0].as_py()] * len(cos), pa.string()), pa.array([key[1].as_py()] * len(cos), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(cos)], schema=_PAIRS)

    stacks = (
        index.filter("ids is not null").select(*SHARD_KEY, "ids", "vectors", "layers", "widths").join(F.broadcast(slots), SHARD_KEY)
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
    )
    key = [*SHARD_KEY, "slot"]
    n = max(1, min(slots.agg(F.sum("slots")).first()[0] or 0, 16_384))
    more = ["floor"] if least is None else []
    asked = queries.select(*[F.col(c).alias(f"q_{c}") for c in (*key, "class_id", "embedding", *more)])
    q_key = [f"q_{c}" for c in key]
    return stacks.repartition(n, *key).groupBy(*key).cogroup(asked.repartition(n, *q_key).groupBy(*q_key)).applyInArrow(run, _PAIRS_SQL)


def _hops(asked: DataFrame, parts: DataFrame, *more: str) -> DataFrame:
    """A row for every shard beside its own in which a vector (with its ``reach``) is to be searched."""
    beside = F.transform(F.filter(F.arrays_zip("routes", "far"), lambda r: r["far"] <= F.col("reach")), lambda r: r["routes"])
    own = F.when(F.col("subs") > 1, F.array("cell")).otherwise(F.array().cast("array<int>"))  # the other parts of the own cell
    return (
        asked.select(*SHARD_KEY, "class_id", *more, F.explode(F.concat(own, beside)).alias("to"))
        .join(F.broadcast(parts), [*MODEL, "to"])
        .withColumn("to_sub", F.explode(F.sequence(F.lit(0), F.col("to_subs") - 1)))
        .filter("not (to = cell and to_sub = sub)")
        .select(*MODEL, F.col("to").alias("cell"), F.col("to_sub").alias("sub"), "class_id", *more)
    )


def neighbours(vectors: DataFrame, least: float | None = None, top: int = TOP) -> DataFrame:
    """(provider, model_id, a, b, cos): what the shards' own graphs gave and what the searches in the shards beside give.
    With ``least``: pairs at least so similar.  Without: for every vector the nearest of every shard searched; a shard is
    searched if a vector may lie there that is nearer than the ``top``-th of the own shard."""
    # both at most a row per shard
    parts = vectors.groupBy(*MODEL, F.col("cell").alias("to")).agg(F.max("subs").alias("to_subs"))
    counted = lambda hops: hops.groupBy(*SHARD_KEY).agg(F.ceil(F.count(F.lit(1)) / SLOT).cast("int").alias("slots"))
    placed = lambda hops, slots: hops.join(F.broadcast(slots), SHARD_KEY).withColumn("slot", F.pmod(F.xxhash64("class_id", F.lit(2)), F.col("slots")).cast("int"))
    pairs = lambda index: index.filter("a is not null and b is not null").select("provider", "model_id", "a", "b", "cos")
    if least is None:
        index = stored(graphs(vectors, None, None, top), "graphs")
        fifth = index.filter("a is not null and b is null").select("provider", "model_id", F.col("a").alias("class_id"), "cos")
        reach = F.lit(SIGMAS_NEAREST) * F.sqrt(F.greatest(2 - 2 * F.col("cos"), F.lit(0.0)) / F.col("dimensions"))
        asked = vectors.join(fifth, ["provider", "model_id", "class_id"], "left").withColumns({"reach": F.coalesce(reach, F.lit(9.0)), "floor": F.coalesce("cos", F.lit(-2.0))})
        slots = stored(counted(_hops(asked, parts)), "slots")
        hops = _hops(asked, parts, "embedding", "floor")
        return pairs(index).unionByName(searched(index, placed(hops, slots), slots, None, top))
    # of two partners one is no farther from the dividing plane than half their distance across it
    asked = vectors.withColumn("reach", F.lit(SIGMAS / 2 * (2 - 2 * least) ** 0.5) / F.sqrt("dimensions"))
    slots = stored(counted(_hops(asked, parts)), "slots")
    queries = placed(_hops(asked, parts, "embedding"), slots)
    # the first slot is answered where the graph is built; more than one only a shard has that very many ask
    index = stored(graphs(vectors, queries.filter("slot = 0"), least, top), "graphs")
    if not slots.filter("slots > 1").limit(1).count():
        return pairs(index)
    return pairs(index).unionByName(searched(index, queries.filter("slot > 0"), slots, least, top))


def similar_pairs(embeddings: DataFrame, least: float = 0.9, top: int = TOP) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a < b: cosine of at least ``least``, one among the other's ``top`` highest."""
    vectors, members = classes(embeddings)
    members = stored(members, "members")
    found = neighbours(vectors, least, top).select("a", "b", F.round("cos", 12).alias("cos"))
    near = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos")).distinct()
    copied = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    # of the highest of each vector (ties included) ...
    highest = F.rank().over(Window.partitionBy("a").orderBy(F.desc("cos")))
    first = near.withColumn("k", highest).filter(F.col("k") <= top).drop("k")
    # ... those to which fewer than top chunks are strictly nearer; classes count with all their copies, and the own copies
    # are nearer than anything that is not itself as near as a copy
    first = first.join(copied.select(F.col("class_id").alias("b"), F.col("m").alias("mb")), "b", "left").join(copied.select(F.col("class_id").alias("a"), F.col("m").alias("ma")), "a", "left")
    nearer = Window.partitionBy("a").orderBy(-F.round(F.col("cos") * 1e12).cast("long")).rangeBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.coalesce("mb", F.lit(1))).over(nearer), F.lit(0)) + F.when(F.col("cos") < 1.0, F.coalesce("ma", F.lit(1)) - 1).otherwise(0)
    linked = first.withColumn("before", before).filter(F.col("before") < top).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    # the limit is applied before the shuffle, so a class of many copies doesn't come to one task
    heads = members.withColumn("r", F.row_number().over(Window.partitionBy("class_id").orderBy("chunk_id"))).filter(F.col("r") <= EXPAND).drop("r")
    later = members.join(heads, ["class_id", "chunk_id"], "left_anti")
    # copies of one vector are as near as can be
    same = copied.select(F.col("class_id").alias("x"), F.col("class_id").alias("y"))
    links = stored(linked.unionByName(same), "links")
    side = lambda m, c, n: m.select(F.col("class_id").alias(c), F.col("chunk_id").alias(n))
    forth = links.join(side(heads, "x", "i"), "x").join(side(members, "y", "j"), "y").select("i", "j")
    # what the heads of y have with the later members of x
    back = links.join(side(heads, "y", "j"), "y").join(side(later, "x", "i"), "x").select("i", "j")
    return (
        forth.unionByName(back)
        .filter("i <> j")
        .select(F.least("i", "j").alias("chunk_id_a"), F.greatest("i", "j").alias("chunk_id_b"))
        .distinct()
    )


def copies(embeddings: DataFrame) -> DataFrame:
    """(provider, model_id, first_chunk_id, chunk_id, copies): the chunks of each vector that several chunks of a model
    have; a vector is named by the first of its chunks."""
    members = stored(keyed(embeddings).select("provider", "model_id", "class_id", "chunk_id").distinct(), "members")
    many = members.groupBy("class_id").agg(F.min("chunk_id").alias("first_chunk_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return members.join(many, "class_id").select("provider", "model_id", "first_chunk_id", "chunk_id", "copies")


def nearest(embeddings: DataFrame, top: int = TOP) -> DataFrame:
    """(provider, model_id, chunk_id, neighbours): the ``top`` most similar chunks of each chunk's vector, best first,
    ties by chunk_id; an exact copy is as near as can be."""
    vectors, members = classes(embeddings)
    members = stored(members, "members")
    found = neighbours(vectors, None, top)
    w = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    best = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).select("provider", "model_id", "a", "b", "cos")
    # of each class only the first members can be among the nearest
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("class_id").orderBy("chunk_id"))).filter(F.col("r") <= top + 1).drop("r")
    own = vectors.select("provider", "model_id", F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.lit(1.0).alias("cos"))
    options = (
        best.unionByName(own)
        .join(first.select(F.col("class_id").alias("b"), F.col("chunk_id").alias("other")), "b")
        .groupBy("provider", "model_id", "a")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.round("cos", 12)).alias("d"), "other"))), 1, 2 * top + 2).alias("o"))
    )
    return (
        options.join(members.select(F.col("class_id").alias("a"), "chunk_id"), "a")
        .select("provider", "model_id", "chunk_id", F.slice(F.filter("o", lambda x: x["other"] != F.col("chunk_id")), 1, top).alias("o"))
        .select("provider", "model_id", "chunk_id", F.transform("o", lambda x: x["other"]).alias("neighbours"), F.transform("o", lambda x: F.round(-x["d"], 6)).alias("cosines"))
    )
