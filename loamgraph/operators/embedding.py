"""Embedders and what is embedded: a protocol, one embedder without a model, and the fail-closed job."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import Protocol, runtime_checkable

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Texts sent to an embedder at once.
BATCH = 16


@runtime_checkable
class Embedder(Protocol):
    provider: str
    model_id: str
    dimensions: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class WordHashes:
    """Vectors of hashed words and word pairs: no model, the same everywhere; near for texts that share words."""

    provider, model_id = "local", "word-hashes"

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        words = re.findall(r"[a-z0-9]+", text.lower())
        v = [0.0] * self.dimensions
        for w in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))] or [""]:
            h = xxhash.xxh64_intdigest(w)
            v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        size = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / size for x in v] if any(v) else [1.0, *v[1:]]


def checked(embedder: Embedder, texts: list[str]) -> list[list[float]]:
    """A batch's vectors; an error if their number, their sizes or a number in them is not as it must be."""
    out = embedder.embed_batch(texts)
    if len(out) != len(texts):
        raise ValueError(f"{len(out)} vectors for {len(texts)} texts")
    for v in out:
        if len(v) != embedder.dimensions or not all(map(math.isfinite, v)):
            raise ValueError(f"a vector of {embedder.model_id} has another size than {embedder.dimensions} or holds numbers that are not finite")
    return out


def embedded(rows: DataFrame, key: str, text: str, embedder: Embedder, batch: int = BATCH) -> DataFrame:
    """(key, embedding) of every row with a text.  Any error fails the job, so nothing is committed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b[text].tolist()
            yield pd.DataFrame({key: b[key], "embedding": [v for a in range(0, len(texts), batch) for v in checked(embedder, texts[a : a + batch])]})

    return rows.filter(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} string, embedding array<float>")


def missing(chunks: DataFrame, embeddings: DataFrame, embedder: Embedder) -> DataFrame:
    """Chunks without a vector of this embedder for the content they have now."""
    key = ["chunk_id", "content_hash"]
    have = embeddings.filter((F.col("provider") == embedder.provider) & (F.col("model_id") == embedder.model_id) & (F.col("dimensions") == embedder.dimensions))
    return chunks.withColumn("content_hash", F.lower("content_hash")).join(have.select("chunk_id", F.lower("content_hash").alias("content_hash")).distinct(), key, "left_anti")


def embed_missing(chunks: DataFrame, embeddings: DataFrame, embedder: Embedder) -> DataFrame:
    """The vectors that are missing, as rows of embeddings."""
    todo = missing(chunks, embeddings, embedder).dropDuplicates(["chunk_id"])
    made = embedded(todo, "chunk_id", "content", embedder)
    rows = todo.select("chunk_id", "content_hash").join(made, "chunk_id")
    identity = {"provider": F.lit(embedder.provider), "model_id": F.lit(embedder.model_id), "dimensions": F.lit(embedder.dimensions)}
    name = F.concat_ws(":", "chunk_id", F.lit(embedder.provider), F.lit(embedder.model_id), F.lit(str(embedder.dimensions)), "content_hash")
    return rows.withColumns(identity).select(T.uuid5(name).alias("embedding_id"), "chunk_id", "provider", "model_id", "dimensions", "content_hash", "embedding")
