"""Reranking by a pluggable scorer, the relevance gate, refusals, citations and the context of an answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.sources.tables import ensure_checkpoint_dir

Scorer = Callable[[Column, Column], Column]
#: Pairs of a query and a document in a group, on average, and bytes of their queries; a group is broadcast to where texts are read.
PAIRS, QUERY_BYTES = 262_144, 2**26


def overlap_score(query: Column, text: Column) -> Column:
    """Stand-in for a model: the share of the query's distinct tokens that the text holds, 0 for none."""
    asked = F.array_distinct(T.tokens(query))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, T.tokens(text))) / F.size(asked))


def rerank(candidates: DataFrame, top_k: int, scorer: Scorer = overlap_score) -> DataFrame:
    """``candidates(query_id, query, text, rank, ...)`` with rerank_score, cut to the best top_k, as ``position``.

    Null scores count as 0; ties keep the order of rank.
    """
    return best(scored(candidates, scorer), top_k)


def scored(candidates: DataFrame, scorer: Scorer = overlap_score) -> DataFrame:
    """``candidates`` with rerank_score, after which texts need not travel further."""
    return candidates.withColumn("rerank_score", scorer(F.col("query"), F.col("text")))


def best(scored: DataFrame, top_k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.coalesce("rerank_score", F.lit(0.0)).desc(), "rank")
    return scored.withColumn("position", F.row_number().over(w)).where(F.col("position") <= top_k)


def rerank_where_read(found: DataFrame, queries: DataFrame, documents: DataFrame, top_k: int, scorer: Scorer = overlap_score) -> DataFrame:
    """``rerank`` of ``found(query_id, doc_id, rank, ...)``, its ``queries(query_id, query)`` and ``documents(doc_id, text, ...)``, without query and text.

    No text is shuffled or written: a group of queries goes with the keys it found
    to where the documents are read, one read for each group. ``found`` is read
    for each group too, so that it should be written, and has a bounded number of
    rows for each query.
    """
    ensure_checkpoint_dir(found.sparkSession)
    n_found = found.count()
    n_queries, n_bytes = queries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("query")), F.lit(0))).head()
    n_groups = max(1, -(-n_found // PAIRS), -(-n_bytes * n_found // (QUERY_BYTES * max(1, n_queries))))
    ranked = None
    for part in range(n_groups):
        own = F.pmod(F.xxhash64("query_id"), F.lit(n_groups)) == part
        pairs = found.where(own).join(queries.where(own), "query_id")
        few = best(scored(documents.join(F.broadcast(pairs), "doc_id"), scorer).drop("text", "query"), top_k).checkpoint()
        ranked = few if ranked is None else ranked.unionByName(few)
    return ranked


def gate(reranked: DataFrame, least: float) -> DataFrame:
    """Rows whose relevance, the rerank score or else the fused one, reaches ``least``; a gate of 0 keeps all."""
    return reranked.where(F.coalesce("rerank_score", "score") >= least) if least > 0 else reranked


def refusal_reason(top_relevance: Column, n_candidates: Column, least: float) -> Column:
    """Why a query is refused; of fixed wording, for programs to read."""
    none = "no_candidates: the collection returned no results for this query (empty collection, or filters excluded everything)"
    below = (
        "below_threshold: top rerank score %s is under the min_relevance gate of %s "
        "— the corpus does not contain sufficiently relevant information to answer this query"
    )
    shown = F.coalesce(F.format_string("%.3f", top_relevance), F.lit("n/a"))
    return F.when(n_candidates == 0, none).otherwise(F.format_string(below, F.when(top_relevance.isNull(), "n/a").otherwise(shown), F.lit(f"{least:.3f}")))


def responses(queries: DataFrame, reranked: DataFrame, kept: DataFrame, retrieved: DataFrame, least: float = 0.3) -> DataFrame:
    """One row for each query, refused ones too: answer_context, citations, counts and the refusal.

    ``reranked`` and ``kept`` carry query_id, position, score, rerank_score, url, title,
    text; ``retrieved`` the rows before the cut. Each query has a bounded number
    of kept rows (rerank_top_k).
    """
    relevance = F.coalesce("rerank_score", "score")
    w = Window.partitionBy("query_id").orderBy("position")
    source = F.when(F.coalesce("url", F.lit("")) == "", "unknown").otherwise(F.col("url"))
    cited = kept.withColumn("index", F.row_number().over(w)).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("index", source.alias("source"), "title", F.round(relevance, 4).alias("relevance")))).alias("citations"),
        F.array_sort(F.collect_list(F.struct("index", F.concat(F.lit("["), F.col("index"), F.lit("] (source: "), source, F.lit(")\n"), F.coalesce("text", F.lit(""))).alias("part")))).alias("parts"),
        F.count("*").alias("total_reranked"),
    )
    tops = reranked.groupBy("query_id").agg(F.max(relevance).alias("top_relevance"))
    counts = retrieved.groupBy("query_id").agg(F.count("*").alias("total_retrieved"))
    joined = queries.join(cited, "query_id", "left").join(tops, "query_id", "left").join(counts, "query_id", "left")
    n, refused = F.coalesce("total_retrieved", F.lit(0)), F.col("total_reranked").isNull()
    return joined.select(
        "query_id", "query",
        F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("answer_context"),
        F.coalesce("citations", F.array().cast(dict(cited.dtypes)["citations"])).alias("citations"),
        n.alias("total_retrieved"), F.coalesce("total_reranked", F.lit(0)).alias("total_reranked"), refused.alias("refused"),
        F.when(refused, refusal_reason(F.col("top_relevance"), n, least)).alias("refusal_reason"), "top_relevance",
    )
