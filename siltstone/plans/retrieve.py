"""Retrieve: dense lists of each variant and the sparse list, fused, reranked, gated, diversified and cited, for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import dense, expand, fusion, rerank, sparse
from siltstone.plans.embed import QUERY_PREFIX, Embedder
from siltstone.plans.settings import Settings, overfetch
from siltstone.sources.tables import ensure_checkpoint_dir


def embedded_variants(queries: DataFrame, embedder: Embedder, settings: Settings = Settings()) -> DataFrame:
    """(query_id, list_id, vector) of each variant of ``queries(query_id, query)``; list 0 is the query itself."""
    variants = queries.select("query_id", F.posexplode(expand.retrieval_variants(F.col("query"), settings.num_queries, settings.use_hyde)).alias("list_id", "variant"))
    return variants.select("query_id", "list_id", embedder(F.concat(F.lit(QUERY_PREFIX), F.col("variant"))).alias("vector"))


def ranked_lists(queries: DataFrame, points: DataFrame, embedder: Embedder, settings: Settings = Settings(), asked: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, list_id, rank, row_id, weight): a dense list for each variant, and the sparse list of the query itself.

    ``queries(query_id, query)``, ``points(row_id, text, embedding)``. The sparse
    list has the number after the last possible variant. ``asked`` are the
    variants and ``vectors`` the points' (row_id, embedding) if they are made already.
    """
    n = settings.num_queries
    asked = embedded_variants(queries, embedder, settings) if asked is None else asked
    near = dense.search(
        asked.select(F.struct("query_id", "list_id").alias("query_id"), "vector"), (points if vectors is None else vectors).select("row_id", F.col("embedding").alias("vector")),
        overfetch(settings.top_k, n), least=settings.score_threshold or None,
    )
    weight = F.when(F.col("query_id.list_id") == 0, fusion.FIRST_WEIGHT).otherwise(fusion.FURTHER_WEIGHT)
    lists = near.select("query_id.query_id", F.col("query_id.list_id").alias("list_id"), "rank", "row_id", weight.alias("weight"))
    if settings.use_hybrid:
        words = sparse.search(queries, points.select(F.col("row_id").alias("doc_id"), "text"), overfetch(settings.top_k, n))
        lists = lists.unionByName(words.select("query_id", F.lit(n).alias("list_id"), "rank", F.col("doc_id").alias("row_id"), F.lit(fusion.SPARSE_WEIGHT).alias("weight")))
    return lists


def retrieve(queries: DataFrame, points: DataFrame, embedder: Embedder, settings: Settings = Settings(), scorer: rerank.Scorer = rerank.overlap_score) -> DataFrame:
    """One response for each query, refused ones included; see rerank.responses.

    Only ids and ranks travel until fusion; texts are joined to the at most
    top_k rows of a query afterwards. Vectors, which may be costly to make, and
    the bounded lists of each query are written once.
    """
    ensure_checkpoint_dir(points.sparkSession)
    vectors = points.select("row_id", "embedding").checkpoint()
    asked = embedded_variants(queries, embedder, settings).checkpoint()
    lists = ranked_lists(queries, points, embedder, settings, asked, vectors)
    fused = fusion.reciprocal_rank_fusion(lists).where(F.col("rank") <= settings.top_k).checkpoint()
    found = fused.join(points.select("row_id", "url", "title", "text"), "row_id").join(queries.select("query_id", "query"), "query_id")
    cut = settings.rerank_top_k * (3 if settings.use_mmr else 1)
    reranked = rerank.rerank(found, cut, scorer).checkpoint()
    kept = rerank.gate(reranked, settings.min_relevance)
    if settings.use_mmr:
        query_vectors = asked.where("list_id = 0").select("query_id", F.col("vector").alias("query_vector"))
        listed = kept.select("query_id", "row_id", F.col("position").alias("rank")).join(vectors.withColumnRenamed("embedding", "vector"), "row_id").join(query_vectors, "query_id", "left")
        chosen = fusion.maximal_marginal_relevance(listed, settings.rerank_top_k, settings.mmr_lambda)
        kept = kept.drop("position").join(chosen, ["query_id", "row_id"])
    return rerank.responses(queries.select("query_id", "query"), reranked, kept, fused, settings.min_relevance)


