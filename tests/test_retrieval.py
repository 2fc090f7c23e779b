from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import dense, fusion, rerank, sparse
from siltstone.plans import embed, queries, retrieve
from siltstone.plans.settings import Settings, overfetch
from siltstone.sources import tables

DOCS = [("d1", "red apple pie and apple tart"), ("d2", "green apple"), ("d3", "the blue car is fast, a fast car"), ("d4", ""), ("d5", None)]


def near(got, want):
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want), got


def test_bm25(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    posted = sparse.postings(docs)
    counts, stats = sparse.term_counts(posted), sparse.collection_stats(posted)
    assert stats.head().asDict() == {"n_docs": 3, "avgdl": 4.0}
    weights = {(r.doc_id, r.term_id): r.weight for r in sparse.document_weights(posted, counts, stats).collect()}
    assert weights["d1", 523792574] == pytest.approx(0.6214924) and weights["d3", 835998747] == pytest.approx(1.2969643)
    asked = spark.createDataFrame([(1, "apple fast apple zebra"), (2, ""), (3, None)], "query_id int, query string")
    near({r.term_id: r.weight for r in sparse.query_weights(asked, counts, stats).collect()}, {523792574: 0.94000726, 835998747: 0.98082925})
    found = sparse.search(asked, docs, 5).orderBy("rank").collect()
    assert [(r.query_id, r.doc_id) for r in found] == [(1, "d3"), (1, "d1"), (1, "d2")]
    near({r.doc_id: r.score for r in found}, {"d3": 1.27210053, "d1": 0.58420737, "d2": 0.57007332})
    plain = {r.doc_id: r.score for r in sparse.search(asked, docs, 5, idf_power=1).collect()}
    assert plain["d3"] == pytest.approx(1.2969643)


def test_settings_from_environment():
    read = Settings.from_environment({"X_TOP_K": "7", "X_USE_MMR": "Yes", "X_MIN_RELEVANCE": " ", "TOP_K": "9", "X_MMR_LAMBDA": "0.2"}, "X_")
    assert read == Settings(top_k=7, use_mmr=True, mmr_lambda=0.2)
    for bad in ({"TOP_K": "0"}, {"TOP_K": "many"}):
        with pytest.raises(ValueError):
            Settings.from_environment(bad)


def test_bm25_empty(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "apple")], "query_id int, query string")
    assert sparse.search(asked, docs).count() == 0
    assert sparse.collection_stats(sparse.postings(docs)).head().asDict() == {"n_docs": 0, "avgdl": None}


def test_merged_stats(spark):
    a, b = spark.createDataFrame(DOCS[:1], "doc_id string, text string"), spark.createDataFrame(DOCS[1:], "doc_id string, text string")
    one, two = sparse.postings(a), sparse.postings(b)
    assert sparse.merged_stats(sparse.collection_stats(one), sparse.collection_stats(two)).head().asDict() == {"n_docs": 3, "avgdl": 4.0}
    merged = {r.term_id: r.df for r in sparse.merged_counts(sparse.term_counts(one), sparse.term_counts(two)).collect()}
    assert merged[523792574] == 2


def test_rrf(spark):
    lists = [["a", "b", "c"], ["b", "d"], ["d", "a"]]
    rows = [(1, n, rank, x, w) for n, (own, w) in enumerate(zip(lists, (1.0, 0.6, 0.7))) for rank, x in enumerate(own, 1)]
    ranked = spark.createDataFrame(rows, "query_id int, list_id int, rank int, row_id string, weight double")
    got = fusion.reciprocal_rank_fusion(ranked).orderBy("rank").collect()
    assert [r.row_id for r in got] == ["a", "b", "d", "c"]
    near({r.row_id: r.score for r in got}, {"a": 0.02768377, "b": 0.0259651, "d": 0.02115283, "c": 0.01587302})
    ties = spark.createDataFrame([(1, 0, 1, "x", 1.0), (1, 0, 2, "y", 1.0), (1, 1, 1, "y", 1.0), (1, 1, 2, "x", 1.0)], ranked.schema)
    assert [r.row_id for r in fusion.reciprocal_rank_fusion(ties).orderBy("rank").collect()] == ["x", "y"]
    assert fusion.reciprocal_rank_fusion(ranked.limit(0)).count() == 0


@pytest.mark.parametrize(("trade", "order"), [(1.0, "abcd"), (0.7, "abce"), (0.5, "adbe"), (0.0, "adec")])
def test_mmr(spark, trade, order):
    vectors = {"a": [1.0, 0.0], "b": [0.98, 0.199], "c": [0.6, 0.8], "d": [0.0, 1.0], "e": []}
    rows = [(1, k, i, v, [1.0, 0.1]) for i, (k, v) in enumerate(vectors.items(), 1)]
    got = fusion.maximal_marginal_relevance(spark.createDataFrame(rows, "query_id int, row_id string, rank int, vector array<double>, query_vector array<double>"), 4, trade)
    assert "".join(r.row_id for r in got.orderBy("position").collect()) == order


def test_mmr_without_vectors_and_bounds(spark):
    rows = spark.createDataFrame([(1, "a", 2, None, None), (1, "b", 1, [1.0], None)], "query_id int, row_id string, rank int, vector array<double>, query_vector array<double>")
    assert [r.row_id for r in fusion.maximal_marginal_relevance(rows, 2).orderBy("position").collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        fusion.maximal_marginal_relevance(rows, 2, 1.5)


def test_cosine(one):
    c = dense.cosine(F.col("a"), F.col("b"))
    assert one(c, a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(2**-0.5)
    assert one(c, a=[0.0, 0.0], b=[1.0, 1.0]) == 0 and one(c, a=[1.0, 5.0], b=[1.0]) == pytest.approx(1)


def test_dense_search(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)).round(1)
    x[10] = x[11] = x[12]
    rows = [(i, [float(v) for v in x[i]], i % 2) for i in range(60)] + [(100, None, 0), (101, [], 0), (102, [float("nan")] * 5, 0), (103, [1.0, 2.0], 0)]
    table = spark.createDataFrame(rows, "row_id int, vector array<double>, label int")
    asked = table.where("row_id < 20").withColumnRenamed("row_id", "query_id")
    got = {}
    for r in dense.search(asked, table, 4, by=["label"], least=0.1).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.row_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(20):
        score = {i: round(float(unit[q] @ unit[i]), 9) for i in range(60) if i % 2 == q % 2}
        assert got[q] == sorted((i for i in score if score[i] >= 0.1), key=lambda i: (-score[i], i))[:4]
    assert all(q != r for q, r in dense.search(asked, table, 4, include_self=False).select("query_id", "row_id").collect())
    assert dense.search(asked, table.limit(0), 4).count() == 0


POINTS = [
    (1, "u1", "Red", "red apple pie", [1.0, 0.0]), (2, None, "Green", "green apple", [0.9, 0.1]), (3, "u3", "Blue", "blue car", [0.0, 1.0]),
]


def test_retrieve_answers_and_refuses(spark):
    embedder = embed.hashed(32)
    points = spark.createDataFrame(POINTS, "row_id int, url string, title string, text string, embedding array<double>").withColumn("embedding", embedder(F.col("text")))
    asked = spark.createDataFrame([(7, "green apple"), (8, "quantum boson")], "query_id int, query string")
    got = {r.query_id: r for r in retrieve.retrieve(asked, points, embedder, Settings(top_k=5, rerank_top_k=2)).collect()}
    assert not got[7].refused and got[7].citations[0].source == "unknown" and got[7].citations[0].relevance == 1.0
    assert got[7].answer_context.startswith("[1] (source: unknown)\ngreen apple\n\n[2] (source: u1)\nred apple pie")
    assert got[8].refused and got[8].refusal_reason.startswith("below_threshold: top rerank score 0.000 is under the min_relevance gate of 0.300")
    assert got[8].citations == [] and got[8].total_reranked == 0
    none = retrieve.retrieve(asked, points.limit(0), embedder, Settings()).collect()
    assert len(none) == 2 and all(r.refused and r.refusal_reason.startswith("no_candidates: ") and r.total_retrieved == 0 for r in none)


def test_mmr_in_plan(spark):
    embedder = embed.hashed(32)
    points = spark.createDataFrame(POINTS, "row_id int, url string, title string, text string, embedding array<double>").withColumn("embedding", embedder(F.col("text")))
    asked = spark.createDataFrame([(7, "apple")], "query_id int, query string")
    row = retrieve.retrieve(asked, points, embedder, Settings(top_k=5, rerank_top_k=2, use_mmr=True, min_relevance=0)).head()
    assert row.total_reranked == 2


def test_settings():
    with pytest.raises(ValueError):
        Settings(top_k=0)
    assert overfetch(20, 1) == 20 and overfetch(5, 3) == 7


def test_gate_off_keeps_all(spark):
    rows = spark.createDataFrame([(1, None, 0.1), (1, 0.9, 0.1)], "query_id int, rerank_score double, score double")
    assert rerank.gate(rows, 0).count() == 2 and rerank.gate(rows, 0.3).count() == 1


def test_bm25_writes_neither_postings_that_nobody_asks_nor_pairs(spark):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choice(words, 200)) + " common") for i in range(300)] + [(7, "common rare rare"), (None, "common")]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    asked = spark.createDataFrame([(q, f"common word{q % 20} word{q % 20} rare") for q in range(200)], "query_id int, query string")
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("part-*"))
    before = size()
    found = sparse.search(asked, documents, 4)
    assert size() - before < 200_000
    posted = sparse.postings(documents)
    counts, stats = sparse.term_counts(posted), sparse.collection_stats(posted)
    pairs = sparse.dot_products(sparse.query_weights(asked, counts, stats), sparse.document_weights(posted, counts, stats), ["term_id"])
    want = sparse.top_k(pairs.withColumn("score", F.round("score", 9)), 4)
    assert found.count() == 800 and {tuple(r) for r in found.collect()} == {tuple(r) for r in want.select(found.columns).collect()}


def test_texts_are_not_written_for_answers_that_show_none(spark, tmp_path):
    rows = [(i, f"text about apples number{i}", f"apples number{i}", "u") for i in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string, title string, url string").write.parquet(str(tmp_path / "documents.parquet"))
    best = queries._reranked(spark, str(tmp_path))[2]
    assert best.count() == 10 and best.where("text is not null").count() == 0
    assert {(r.query_id, r.doc_id) for r in queries.rerank_gate(spark, str(tmp_path)).collect()} == {(0, 0), (20, 20)}


def test_dense_search_sends_no_vector_twice(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 7)
    monkeypatch.setattr(dense, "NUMBERS", 40, raising=False)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 4)).round(1)
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(50)], "row_id int, vector array<double>").repartition(6)
    found = dense.search(rows.where("row_id < 25").withColumnRenamed("row_id", "query_id"), rows, 3)
    assert "CoGroup" not in found._jdf.queryExecution().toString()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.row_id)
    assert got == {q: sorted(range(50), key=lambda i: (-round(float(unit[q] @ unit[i]), 9), i))[:3] for q in range(25)}


def test_texts_that_no_query_finds_are_not_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "spread", lambda df: df)
    other = lambda: " ".join(f"x{n}" for n in rng.integers(10**9, size=200))
    rng = np.random.default_rng(5)
    rows = [(i, f"text about apples number{i}" if i % 20 < 1 else other(), f"apples number{i}", "u") for i in range(2000)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, title string, url string")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    written = lambda: {p: p.stat().st_size for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}
    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        answers = queries.citations(spark, str(tmp_path))
        cited = answers.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(n for p, n in written().items() if p not in before) < 500_000
    assert {(r["query_id"], r["index"], r["relevance"]) for r in cited} == {(q, 1, 1.0) for q in range(0, 2000, 20)}


def test_among_keeps_all_held_keys(spark):
    rows = spark.range(2000).withColumnRenamed("id", "doc_id").unionByName(spark.createDataFrame([(None,)], "doc_id bigint"))
    held = rows.where("doc_id % 20 = 0")
    passed = {r.doc_id for r in tables.among(rows, "doc_id", held).collect()}
    assert passed >= set(range(0, 2000, 20)) and len(passed) < 200
    assert tables.among(rows, "doc_id", held.limit(0)).count() == 0
    assert tables.among(rows, "doc_id", held.select(F.col("doc_id").cast("int").alias("doc_id"))).count() == len(passed)


def shuffled_by(spark, path, name):
    """Bytes that a query shuffles where 1,900 long texts hold none of the words asked for, and its rows."""
    rng = np.random.default_rng(6)
    rows = [(i, f"text about apples number{i}" if i % 20 < 1 else " ".join(f"x{n}" for n in rng.integers(10**9, size=200)), f"apples number{i}", "u") for i in range(2000)]
    spark.createDataFrame(rows, "doc_id bigint, text string, title string, url string").write.parquet(f"{path}/documents.parquet")
    written = lambda: {p: p.stat().st_size for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}
    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        answers = queries.QUERIES[name](spark, str(path))
        rows = answers.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return sum(n for p, n in written().items() if p not in before), rows


def test_refusal_reasons_shuffles_no_text_that_no_query_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "spread", lambda df: df)
    written, rows = shuffled_by(spark, tmp_path, "refusal_reasons")
    assert written < 500_000
    assert {tuple(r) for r in rows} == {(q, None) for q in range(0, 2000, 20)}


def test_rerank_gate_shuffles_no_text_that_no_query_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "spread", lambda df: df)
    written, rows = shuffled_by(spark, tmp_path, "rerank_gate")
    assert written < 500_000
    assert {tuple(r) for r in rows} == {(q, q, 1, 1.0) for q in range(0, 2000, 20)}


def found_by(spark, path, name):
    """Bytes that a query shuffles where all 1,000 long texts are found, and its rows."""
    rng = np.random.default_rng(7)
    long = lambda: " ".join(f"x{n}" for n in rng.integers(10**9, size=200))
    rows = [(i, f"number{i - i % 10} {long()}", f"number{i}" if i % 40 else f"number{i} other", "u") for i in range(0, 2000, 2) if i % 20 < 10]
    spark.createDataFrame(rows, "doc_id bigint, text string, title string, url string").write.parquet(f"{path}/documents.parquet")
    written = lambda: {p: p.stat().st_size for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}
    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = queries.QUERIES[name](spark, str(path)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return sum(n for p, n in written().items() if p not in before), rows


def test_refusal_reasons_shuffles_no_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "spread", lambda df: df)
    monkeypatch.setattr(rerank, "PAIRS", 100, raising=False)
    written, rows = found_by(spark, tmp_path, "refusal_reasons")
    assert written < 300_000
    assert {(r.query_id, (r.refusal_reason or "")[:41]) for r in rows} == {(q, "" if q % 40 else "below_threshold: top rerank score 0.500 i") for q in range(0, 2000, 20)}


def test_rerank_where_texts_are_read(spark, monkeypatch):
    asked = spark.createDataFrame([(1, "red apple"), (2, "the"), (3, None), (4, "car"), (5, "pie")], "query_id int, query string")
    found = [(q, d, 0.5, rank) for q in (1, 2, 3, 4) for rank, (d, _) in enumerate(DOCS, 1)] + [(4, "gone", 0.1, 6), (6, "d1", 0.1, 1)]
    found = spark.createDataFrame(found, "query_id int, doc_id string, score double, rank int")
    documents = spark.createDataFrame([(*d, "u") for d in [*DOCS, ("d6", "apple"), (None, "apple")]], "doc_id string, text string, url string")
    want = rerank.rerank(found.join(asked, "query_id").join(documents, "doc_id"), 3).drop("text", "query")
    for pairs, size in ((262_144, 2**26), (3, 2**26), (262_144, 8)):
        monkeypatch.setattr(rerank, "PAIRS", pairs)
        monkeypatch.setattr(rerank, "QUERY_BYTES", size)
        got = rerank.rerank_where_read(found, asked, documents, 3)
        assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert rerank.rerank_where_read(found.limit(0), asked.limit(0), documents, 3).count() == 0


def test_rerank_gate_shuffles_no_more_for_more_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sparse, "BLOCK", 20)
    rows = [(i, f"common number{i} " + " ".join(f"word{j}" for j in range(i % 20, 20)), f"common number{i} word{i // 20 % 20}", "u") for i in range(2000)]
    spark.createDataFrame(rows, "doc_id bigint, text string, title string, url string").write.parquet(f"{tmp_path}/documents.parquet")
    shuffled, top_k = [], sparse.top_k
    monkeypatch.setattr(sparse, "top_k", lambda scored, *more: shuffled.append(scored.count()) or top_k(scored, *more))
    rows = queries.rerank_gate(spark, str(tmp_path)).collect()
    assert len(shuffled) == 1 and shuffled[0] < 30_000
    assert {tuple(r) for r in rows} == {(q, q, 1, 1.0) for q in range(0, 2000, 20)}


def test_postings_as_bytes():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28 - 1, 2**28, 2**32 - 1])
    packed, ends = sparse._bytes(values)
    assert ends[:4].tolist() == [1, 2, 3, 5] and ends[-1] == len(packed)
    assert all(np.array_equal(*x) for x in zip(sparse._numbers(packed), (values, ends)))
    assert [len(x) for x in sparse._bytes(values[:0])] == [0, 0]
    assert sparse._first_halves(np.array([2, 0, 1])).tolist() == [0, 1, 4]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_dense_search_keeps_a_bounded_number_of_ties(spark, monkeypatch, kind):
    monkeypatch.setattr(dense, "BLOCK", 64)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 4)).round(1)
    x[100:400] = x[100]
    ids = [int(i) if kind == "bigint" else str(i) for i in rng.permutation(600)]
    rows = spark.createDataFrame([(i, [float(v) for v in own]) for i, own in zip(ids, x)], f"row_id {kind}, vector array<double>").repartition(3)
    y = np.array([[0.0] * 4, x[100], x[5]])
    asked = spark.createDataFrame([(q, [float(v) for v in own]) for q, own in enumerate(y)], "query_id int, vector array<double>")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    score = (unit(y) @ unit(x).T).round(9)
    want = {q: [ids[i] for i in sorted(range(600), key=lambda i: (-score[q, i], ids[i]))[:5]] for q in range(3)}
    got = {}
    for r in dense.search(asked, rows, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.row_id)
    assert got == want
    schema = f"query_id int, row_id {kind}, score double"
    met = dense._met(rows.withColumn("kind", F.lit(1)), asked.withColumn("kind", F.lit(1)), 5, -2.0, True, schema)
    assert met.count() <= 3 * 3 * 6


def test_rounding_is_that_of_spark(spark):
    rng = np.random.default_rng(7)
    halves = (rng.integers(0, 10**9, 300) + 0.5) / 1e9
    x = np.concatenate([halves, np.nextafter(halves, 0), np.nextafter(halves, 1), -halves, rng.normal(size=300), [0.0, 1.0, -1.0]])
    rounded = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double").select("i", F.round("v", 9).alias("r")).orderBy("i").collect()
    assert [r.r for r in rounded] == dense._rounded(x).tolist()


def test_vectors_of_zeros_are_compared_once(spark, monkeypatch):
    dots, seen = dense._dots, []
    monkeypatch.setattr(dense, "_dots", lambda x, i, y, j: (seen.append(len(i)), dots(x, i, y, j))[1])
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(50)], "row_id int, vector array<double>")
    asked = spark.createDataFrame([(i, [0.0, 0.0] if i % 2 else [1.0, 0.0]) for i in range(20)], "query_id int, vector array<double>")
    got = {}
    for r in dense.search(asked, rows, 3, include_self=False).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.row_id, r.score))
    assert all(got[q] == [(i, 0.0) for i in range(4) if i != q][:3] for q in range(1, 20, 2)) and len(got) == 20
    schema = "query_id int, row_id int, score double"
    kinds = [df.withColumn("kind", F.lit(1)) for df in (rows.coalesce(1), asked)]
    met = {}
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema: met.setdefault("f", f))
    dense._met(*kinds, 3, -2.0, True, schema)
    out = list(met["f"](kinds[0].toArrow().to_batches()))
    assert sum(len(b) for b in out) >= 20 * 4 and sum(seen) <= 11 * 4


def test_token_ids_of_many_tokens(spark):
    words = ["apple", "it's", "é9", "apple", "x_y-z"]
    want = [r.i for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.token_id(F.col("w")).alias("i")).collect()]
    assert text.token_ids(pa.array(words)).tolist() == want and text.token_ids(pa.array([], pa.string())).tolist() == []
    rows = spark.createDataFrame([("red apple apple",), ("",), (None,)], "t string").select(embed.hashed(8)(F.col("t")).alias("v")).collect()
    plain = np.zeros(8)
    for i in text.token_ids(pa.array(["red", "apple", "apple"])).tolist():
        plain[i % 8] += 1 if (i >> 16) & 1 else -1
    assert rows[0].v == pytest.approx((plain / np.linalg.norm(plain)).tolist()) and rows[1].v == rows[2].v == [0.0] * 8
