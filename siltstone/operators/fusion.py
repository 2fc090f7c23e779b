"""Fusion of ranked lists and diversity selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
#: Weights of the first dense list, of further ones and of the sparse list.
FIRST_WEIGHT, FURTHER_WEIGHT, SPARSE_WEIGHT = 1.0, 0.6, 0.7


def reciprocal_rank_fusion(ranked: DataFrame, k: int = RRF_K, key: str = "row_id") -> DataFrame:
    """(query_id, key, score, rank) from ``ranked(query_id, list_id, rank, key, weight)``.

    score is the sum of weight / (k + rank) over the lists, added in the order of
    list_id so that reruns agree to the last bit; a row not in a list adds
    nothing. Ties go to the first appearance: lowest list, then rank. A row twice
    in one list adds twice.
    """
    terms = F.array_sort(F.collect_list(F.struct("list_id", "rank", (F.col("weight") / (k + F.col("rank"))).alias("part"))))
    fused = ranked.groupBy("query_id", key).agg(terms.alias("terms")).select(
        "query_id", key, F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + t["part"]).alias("score"), F.col("terms")[0].alias("first")
    )
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("first.list_id"), F.col("first.rank"), key)
    return fused.select("query_id", key, "score", F.row_number().over(w).alias("rank"))


def maximal_marginal_relevance(candidates: DataFrame, top_k: int, trade: float = 0.7) -> DataFrame:
    """(query_id, row_id, position): greedy choice of relevant rows unlike those chosen before.

    ``candidates(query_id, row_id, rank, vector, query_vector)``, a bounded list for
    each query (the retrieve plan has at most 100 rows). Each pick is greatest in
    trade * cos(row, query) - (1 - trade) * greatest cos(row, chosen row); the first
    pick has no second part. Ties go to the better rank. A row without vector has
    similarity 0. Without a query vector, or without any vector, the first top_k
    rows by rank are taken. trade outside 0..1 raises ValueError.
    """
    if not 0 <= trade <= 1:
        raise ValueError(f"trade must lie in 0..1, not {trade}")
    kinds = dict(candidates.dtypes)

    def choose(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["rank"])
        query_vector = next((r["query_vector"] for r in rows if r["query_vector"]), None)
        picked = list(range(min(top_k, len(rows))))
        if query_vector and any(r["vector"] for r in rows):
            like = cosines([r["vector"] or [] for r in rows] + [query_vector])
            relevance, near, left, picked = like[:-1, -1], np.full(len(rows), -np.inf), list(range(len(rows))), []
            while left and len(picked) < top_k:
                value = [trade * relevance[i] - ((1 - trade) * near[i] if picked else 0.0) for i in left]
                best = left[int(np.argmax(value))]
                picked.append(best)
                left.remove(best)
                near = np.maximum(near, like[:-1, best])
        out = [{"query_id": rows[i]["query_id"], "row_id": rows[i]["row_id"], "position": n} for n, i in enumerate(picked, 1)]
        return pa.Table.from_pylist(out, schema=pa.schema([group.schema.field("query_id"), group.schema.field("row_id"), ("position", pa.int32())]))

    listed = candidates.select("query_id", "row_id", "rank", F.col("vector").cast("array<double>"), F.col("query_vector").cast("array<double>"))
    return listed.groupBy("query_id").applyInArrow(choose, f"query_id {kinds['query_id']}, row_id {kinds['row_id']}, position int")


def cosines(vectors: list[list[float]]) -> np.ndarray:
    """All cosines of a short list of vectors, over the common length of each pair; 0 where one has no length."""
    out = np.zeros((len(vectors), len(vectors)))
    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors[: i + 1]):
            n = min(len(a), len(b))
            x, y = np.asarray(a[:n], float), np.asarray(b[:n], float)
            size = float(np.linalg.norm(x) * np.linalg.norm(y)) if n else 0.0
            out[i, j] = out[j, i] = float(x @ y) / size if size else 0.0
    return out
