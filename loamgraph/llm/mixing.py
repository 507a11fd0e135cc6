"""Problem 9: mixing sources to target weights.

Sizes are tokens of a public tokenizer, counted once and written to the shared folder.  The mix is the largest in
which every source that has documents gets its target share (shares of sources without documents are spread in
proportion) and no record is used more than its source's cap: whole passes over a source, and a last pass over the
first records of its permutation.

A source's records are hashed into blocks.  The blocks' quotas per output shard come from a multivariate-
hypergeometric splitting tree: the root holds the exact number of blocks of every source, a node splits its shards
in half and draws how many blocks of each source go left, so all shards' quotas add up exactly.  Each shard then
takes disjoint ranges of each source's permuted blocks, and rows are shuffled within the shard only.  The tree works
on sources times shards, never on records; its top, down to groups of ``GROUP`` shards, is drawn by the driver, the rest
of it in one task per group.  A block finds its group and its shard by binary search in the cumulative quotas.

Defined results: a document with a null source or text, and one of a source without a target, is not used; a null or
non-positive share or cap excludes the source; empty texts have no tokens and are used like others; repeated rows
count once; without any usable source the mix is empty; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BLOCK_ROWS = 512
SHARD_TOKENS = 2_000_000
SEED = 20_240_607
#: Shards below one leaf of the driver's part of the tree.
GROUP = 1024
#: Blocks whose running sums are taken in one task.
RUN = 4096


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens); the tokenizer's file is read by the driver and sent along (1.5 MB)."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > 64 << 20:
        raise ValueError("the tokenizer's file is too large to send to every task")
    sent = documents.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(sent.value)
        t.encode_special_tokens = True
        for b in batches:
            texts = b.text.tolist()
            n = [len(e.ids) for a in range(0, len(texts), 256) for e in t.encode_batch(texts[a : a + 256], add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": b.doc_id, "source": b.source, "tokens": np.asarray(n, dtype=np.int64)})

    rows = documents.filter("doc_id is not null and source is not null and text is not null").select("doc_id", "source", "text").dropDuplicates(["doc_id"])
    return rows.mapInPandas(run, "doc_id long, source string, tokens long")


def quotas(available: dict[str, tuple[int, int]], targets: dict[str, tuple[float, int]]) -> dict[str, dict]:
    """Per source the passes and the tokens of the last one.  available: source -> (records, tokens)."""
    usable = {s: t for s, t in targets.items() if s in available and available[s][1] > 0 and t[0] and t[0] > 0 and t[1] and t[1] > 0}
    whole = sum(t[0] for t in usable.values())
    if not usable:
        return {}
    total = min(available[s][1] * cap / (share / whole) for s, (share, cap) in usable.items())
    out = {}
    for s, (share, cap) in usable.items():
        records, tokens = available[s]
        want = min(share / whole * total, float(tokens * cap))
        passes = int(want // tokens)
        rest = int(round(want - passes * tokens))
        if passes >= cap:
            passes, rest = cap, 0
        out[s] = {"records": records, "tokens": tokens, "want": want, "passes": passes, "rest": rest, "share": share / whole}
    return out


def split(counts: np.ndarray, shards: int, rng: np.random.Generator, leaf: int = 1) -> np.ndarray:
    """(leaves, sources): exact block quotas of leaves of at most ``leaf`` shards; every shard's part holds as near as can
    be the same number of blocks."""
    out = []
    todo = [(0, shards, counts.astype(np.int64))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo <= leaf:
            out.append((lo, have))
            continue
        mid = (lo + hi) // 2
        total = int(have.sum())
        left = rng.multivariate_hypergeometric(have, total * (mid - lo) // (hi - lo), method="marginals") if total else have
        todo += [(mid, hi, have - left), (lo, mid, left)]
    return np.stack([have for _, have in sorted(out, key=lambda x: x[0])])


def leaves(shards: int, leaf: int) -> list[tuple[int, int]]:
    """The shards of each of those leaves."""
    out, todo = [], [(0, shards)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= leaf:
            out.append((lo, hi))
        else:
            mid = (lo + hi) // 2
            todo += [(mid, hi), (lo, mid)]
    return sorted(out)


def _coprime(n: int, rng: np.random.Generator) -> int:
    while True:
        a = int(rng.integers(1, max(2, n)))
        if math.gcd(a, n) == 1:
            return a


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> DataFrame:
    """(shard, position, doc_id, source, use, tokens): the mixed records in the order of each output shard."""
    return _mix(stored(count_tokens(documents, tokenizer), "tokens"), targets, shard_tokens, seed)


def _mix(sized: DataFrame, targets: DataFrame, shard_tokens: int, seed: int) -> DataFrame:
    spark = sized.sparkSession
    empty = "shard int, position long, doc_id long, source string, use int, tokens long"
    plan = _plan(sized, targets)
    if not plan:
        return spark.createDataFrame([], empty)
    rng = np.random.default_rng(seed)
    names = sorted(plan)
    for s in names:
        plan[s]["blocks"] = max(1, math.ceil(plan[s]["records"] / BLOCK_ROWS))
    info = spark.createDataFrame([(s, p["blocks"], p["passes"], p["rest"]) for s, p in plan.items()], "source string, blocks int, passes int, rest long")
    rows = sized.join(info, "source").withColumns(
        {"block": F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).cast("int"), "draw": F.xxhash64("doc_id", F.lit(seed + 1))}
    )
    # the last pass takes the first blocks whole, and of the next one the first records
    sums = rows.groupBy("source", "block", "rest").agg(F.sum("tokens").alias("t"))
    # running sums of runs of blocks, then within the runs, so that no task sees all blocks of a source
    sums = stored(sums.withColumn("run", F.floor(F.col("block") / RUN)), "block-sums")
    preceding = (Window.unboundedPreceding, -1)
    runs = sums.groupBy("source", "run").agg(F.sum("t").alias("run_t"))
    runs = runs.withColumn("run_before", F.coalesce(F.sum("run_t").over(Window.partitionBy("source").orderBy("run").rowsBetween(*preceding)), F.lit(0))).drop("run_t")
    inside = F.sum("t").over(Window.partitionBy("source", "run").orderBy("block").rowsBetween(*preceding))
    sums = stored(sums.withColumn("inside", F.coalesce(inside, F.lit(0))).join(runs, ["source", "run"]).withColumn("before", F.col("run_before") + F.col("inside")).select("source", "block", "rest", "t", "before"), "blocks")
    whole = sums.filter("before + t <= rest").select("source", "block").withColumn("part", F.lit(False))
    edge = sums.filter("before < rest and before + t > rest").select("source", "block", "before", "rest")
    running = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    in_edge = (
        rows.drop("rest").join(edge, ["source", "block"])
        .withColumn("run", running)
        .filter(F.col("before") + F.col("run") - F.col("tokens") / 2 <= F.col("rest"))
        .select("doc_id", "source", "tokens", "block", "blocks", "draw", F.col("passes").alias("use"))
    )
    full = rows.filter("passes > 0").select("doc_id", "source", "tokens", "block", "blocks", "draw", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("use"))
    last = rows.join(whole, ["source", "block"], "left_semi").select("doc_id", "source", "tokens", "block", "blocks", "draw", F.col("passes").alias("use"))
    used = full.unionByName(last).unionByName(in_edge)
    # blocks of the last pass: the first ones up to the edge
    counted = {r.source: r.n for r in sums.filter("before < rest").groupBy("source").agg(F.max("block").alias("n")).collect()}  # one row per target
    units = np.array([plan[s]["blocks"] * plan[s]["passes"] + (counted[s] + 1 if s in counted else 0) for s in names])
    total = sum(p["want"] for p in plan.values())
    shards = int(max(1, min(math.ceil(total / shard_tokens), units.sum())))
    quota = split(units, shards, rng, GROUP)
    steps = spark.createDataFrame([(s, int(u), _coprime(int(u), rng), int(rng.integers(0, max(1, int(u))))) for s, u in zip(names, units) if u], "source string, units long, a long, c long")
    ends = np.cumsum(quota, axis=0)  # a row per group of shards
    span = leaves(shards, GROUP)
    column = {s: j for j, s in enumerate(names)}

    def group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = b["at"].to_numpy()
            which = np.zeros(len(b), np.int64)
            for s, rows_ in b.groupby("source").indices.items():
                which[rows_] = np.searchsorted(ends[:, column[s]], at[rows_], side="right")
            yield b.assign(grp=which)

    def place(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        g = int(key[0])
        lo, hi = span[g]
        last = np.cumsum(split(quota[g], hi - lo, np.random.default_rng([seed, lo])), axis=0)
        at = b["at"].to_numpy()
        shard = np.zeros(len(b), np.int64)
        for s, rows_ in b.groupby("source").indices.items():
            j = column[s]
            shard[rows_] = lo + np.searchsorted(last[:, j], at[rows_] - (ends[g, j] - quota[g, j]), side="right")
        return b[["source", "block", "use"]].assign(shard=shard.astype(np.int32))

    unit = (
        used.select("source", "block", "use", "blocks").distinct()
        .join(steps, "source")
        .withColumn("at", F.pmod(F.col("a") * (F.col("use") * F.col("blocks") + F.col("block")) + F.col("c"), F.col("units")))
        .select("source", "block", F.col("use").cast("int").alias("use"), "at")
        .mapInPandas(group, "source string, block int, use int, at long, grp long")
        .groupBy("grp")
        .applyInPandas(place, "source string, block int, use int, shard int")
    )
    order = Window.partitionBy("shard").orderBy(F.xxhash64("draw", "use", F.lit(seed)), "doc_id", "use")
    return (
        used.join(unit, ["source", "block", "use"])
        .withColumn("position", F.row_number().over(order).cast("long"))
        .select("shard", "position", "doc_id", "source", (F.col("use") + 1).cast("int").alias("use"), "tokens")
    )


def _plan(sized: DataFrame, targets: DataFrame) -> dict[str, dict]:
    """Totals of the sources that have a target: as many rows as targets, which a person writes."""
    wanted = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    totals = sized.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("tokens").alias("tokens"))
    rows = wanted.join(totals, "source", "left").collect()
    available = {r.source: (r.records, r.tokens) for r in rows if r.records}
    return quotas(available, {r.source: (r.share or 0.0, r.cap or 0) for r in rows})


def report(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> DataFrame:
    """(source, target_share, available_tokens, used_tokens, actual_share, most_uses) of every target."""
    sized = stored(count_tokens(documents, tokenizer), "tokens")
    used = _mix(sized, targets, shard_tokens, seed)
    per_doc = used.groupBy("source", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    got = per_doc.groupBy("source").agg(F.sum("t").alias("used_tokens"), F.max("n").alias("most_uses"))
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    wanted = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    rows = wanted.join(have, "source", "left").join(got, "source", "left").select("source", "target_share", "max_repeats", zero("available_tokens"), zero("used_tokens"), zero("most_uses"))
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))  # over one row per target
    return rows.withColumn("actual_share", F.round(F.col("used_tokens") / F.greatest(total, F.lit(1)), 6))


def records(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixed records themselves: ``mixed`` with each document's text."""
    texts = documents.filter("doc_id is not null and text is not null").select("doc_id", "text").dropDuplicates(["doc_id"])
    return mixed.join(texts, "doc_id").select(*mixed.columns, "text")


def tokenizer_of(spark: SparkSession) -> str:
    """The path of the tokenizer's file; spark.loamgraph.tokenizer overrides the default."""
    return spark.conf.get("spark.loamgraph.tokenizer", TOKENIZER)
