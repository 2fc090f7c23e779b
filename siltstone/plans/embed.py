"""Embedding: the interface, a deterministic stand-in for a model, and the read-through cache."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T

Embedder = Callable[[Column], Column]
QUERY_PREFIX = "query: "


def hashed(width: int = 64) -> Embedder:
    """Bag of hashed tokens with signs, of unit length; texts without tokens give zeros. No match for a trained model."""

    @F.arrow_udf("array<double>")
    def vectors(tokens: pa.Array) -> pa.Array:
        ids, n = T.token_ids(tokens.flatten()), len(tokens)
        row = np.repeat(np.arange(n), pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64))
        out = np.bincount(row * width + ids % width, np.where((ids >> 16) & 1, 1.0, -1.0), n * width).reshape(n, width)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array((out / np.where(size == 0, 1, size)).ravel()))

    return lambda text: vectors(T.tokens(text))


def cache_key(text: Column, model: str) -> Column:
    """Model and exact text."""
    return F.sha2(F.concat(F.lit(model + "\x00"), text), 256)


def embedded(rows: DataFrame, cache: DataFrame, embedder: Embedder, model: str = "hashed", text: str = "text") -> DataFrame:
    """``rows`` with ``vector`` and ``was_cached``; each distinct text that the cache (text_key, vector) lacks is embedded once."""
    keyed = rows.withColumn("text_key", cache_key(F.col(text), model))
    known = cache.groupBy("text_key").agg(F.first("vector").alias("cached"))
    missing = keyed.where("text_key is not null").groupBy("text_key").agg(F.first(text).alias("t")).join(known, "text_key", "left_anti")
    made = missing.select("text_key", embedder(F.col("t")).alias("made"))
    return (
        keyed.join(known, "text_key", "left")
        .join(made, "text_key", "left")
        .withColumn("vector", F.coalesce("cached", "made"))
        .withColumn("was_cached", F.col("cached").isNotNull())
        .drop("cached", "made")
    )
