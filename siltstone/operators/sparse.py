"""BM25: postings, statistics of a collection, weights, and top-k by a join of query terms with postings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from siltstone.functions import text as T
from siltstone.sources.tables import ensure_checkpoint_dir

K1, B = 1.5, 0.75
#: Documents of a block at most, on average; queries of a group, which is sent to every block.
BLOCK, GROUP = 50_000, 65_536
#: Up to so many asked terms, postings of others are left out before anything is shuffled.
ASKED = 4_194_304


def postings(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term_id, tf, dl) of each term of each document; dl counts all tokens of it.

    Null and empty texts and texts of stop words have no postings. Repeated keys
    count as one document with the tokens of all their rows. Tokens are
    counted where the texts are read, so that a shuffle holds each term of a
    document once.
    """
    tokens = documents.where(F.col(key).isNotNull()).select(F.col(key), T.tokens(F.col(text)).alias("tokens"))
    terms = tokens.select(key, F.explode("tokens").alias("token")).select(key, T.token_id(F.col("token")).alias("term_id"))
    counted = terms.groupBy(key, "term_id").agg(F.count("*").cast("int").alias("tf"))
    return counted.withColumn("dl", F.sum("tf").over(Window.partitionBy(key)).cast("int"))


def term_counts(posted: DataFrame) -> DataFrame:
    """(term_id, df): in how many documents a term occurs."""
    return posted.groupBy("term_id").agg(F.count("*").alias("df"))


def collection_stats(posted: DataFrame) -> DataFrame:
    """One row (n_docs, avgdl), of the documents that have postings; 0 and null for none.

    The parts tf / dl of a document sum to 1, so that sums tell the number of
    documents and no posting is shuffled; rounding takes their errors away.
    """
    n = F.coalesce(F.round(F.sum(F.col("tf") / F.col("dl"))), F.lit(0)).cast("bigint")
    return posted.agg(n.alias("n_docs"), (F.sum("tf") / F.when(n > 0, n)).alias("avgdl"))


def merged_stats(old: DataFrame, new: DataFrame) -> DataFrame:
    """Statistics of two disjoint batches together, as one row (n_docs, avgdl)."""
    both = old.unionByName(new)
    n, total = F.sum("n_docs"), F.sum(F.coalesce(F.col("avgdl"), F.lit(0.0)) * F.col("n_docs"))
    return both.agg(n.alias("n_docs"), (total / F.when(n > 0, n)).alias("avgdl"))


def merged_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy("term_id").agg(F.sum("df").alias("df"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def document_weights(posted: DataFrame, counts: DataFrame, stats: DataFrame, key: str = "doc_id") -> DataFrame:
    """Postings with weight idf * tf(k1+1)/(tf+k1(1-b+b*dl/avgdl)); weights that are not positive are left out.

    A term without count has df 1. Without documents there are no rows.
    """
    raw = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighted = posted.join(counts, "term_id", "left").crossJoin(F.broadcast(stats)).where("n_docs > 0 and avgdl > 0")
    return weighted.select(key, "term_id", "tf", "dl", (idf(F.col("n_docs"), F.coalesce("df", F.lit(1))) * raw).alias("weight")).where("weight > 0")


def query_weights(queries: DataFrame, counts: DataFrame, stats: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """(query_id, term_id, weight) with weight idf * tf; terms that no document holds are dropped."""
    terms = queries.select(F.col(key), F.explode(T.tokens(F.col(text))).alias("token")).select(key, T.token_id(F.col("token")).alias("term_id"))
    counted = terms.groupBy(key, "term_id").agg(F.count("*").alias("tf"))
    weighted = counted.join(counts, "term_id").crossJoin(F.broadcast(stats)).where("df > 0 and n_docs > 0")
    return weighted.select(key, "term_id", (idf(F.col("n_docs"), F.col("df")) * F.col("tf")).alias("weight")).where("weight > 0")


def dot_products(queries: DataFrame, documents: DataFrame, on: list[str], query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """(query, key, score): sums of products over shared terms, of rows that also agree in ``on``.

    Both sides carry a weight; hot terms are split by adaptive skew joins, and
    sums are combined before the second shuffle.
    """
    q = queries.select(query, *on, F.col("weight").alias("query_weight"))
    return q.join(documents.select(key, *on, "weight"), on).groupBy(query, key).agg(F.sum(F.col("query_weight") * F.col("weight")).alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "query_id", key: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best rows of each list with their rank from 1; ties go to the smaller key."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(queries: DataFrame, documents: DataFrame, k: int = 10, idf_power: int = 2) -> DataFrame:
    """BM25 top k of ``documents(doc_id, text)`` for ``queries(query_id, query)``: (query_id, doc_id, score, rank).

    Weights of queries and documents both hold the idf; idf_power 1 takes it out
    of the query, as textbooks have it. Queries without known terms give no rows.
    Beyond the statistics, only postings of terms that some query holds count.

    Documents are dealt to blocks, as one narrow row each with the postings that
    count; a block is written once, sorted and compressed. A task scores all
    queries of a group against its blocks and returns the k best of each, so that
    pairs of a query and a document are never written, and no more rows for more
    blocks.
    """
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    terms = queries.select(F.explode(T.tokens(F.col("query"))).alias("token")).select(T.token_id(F.col("token")).alias("term_id")).distinct()
    asked = np.sort(terms.limit(ASKED + 1).toArrow()["term_id"].to_numpy().astype(np.uint32))
    # counted before texts are looked at
    cores = spark.sparkContext.defaultParallelism
    n_blocks = cores * max(1, -(-documents.select("doc_id").count() // (BLOCK * cores)))
    shared = spark.sparkContext.broadcast(asked if len(asked) <= ASKED else None)
    blocks = _narrow(documents, shared).repartition(n_blocks, "doc_id").sortWithinPartitions("doc_id").mapInArrow(_packed, "block binary").checkpoint()
    # the row with the term -1 has the number of documents and of their tokens
    counted = blocks.mapInArrow(_counted(shared), "term_id bigint, df bigint, total bigint").groupBy("term_id").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).checkpoint()
    counts = counted.where("term_id >= 0").select("term_id", "df")
    stats = counted.where("term_id = -1").select(F.col("df").alias("n_docs"), (F.col("total") / F.col("df")).alias("avgdl"))
    known = query_weights(queries, counts, stats).join(counts, "term_id").crossJoin(F.broadcast(stats)).withColumn("idf", idf(F.col("n_docs"), F.col("df")))
    if idf_power == 1:
        known = known.withColumn("weight", F.col("weight") / F.col("idf"))
    n_groups = max(1, -(-queries.select("query_id").count() // GROUP))
    known = known.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term_id", "weight", "idf"))).alias("terms"), F.first("avgdl").alias("avgdl"))
    known = known.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(n_groups))).checkpoint()
    schema = f"query_id {dict(queries.dtypes)['query_id']}, doc_id {dict(documents.dtypes)['doc_id']}, score double"
    scored = None
    for part in range(n_groups):
        found = _scored(blocks.coalesce(cores), shared.value, known.where(F.col("part") == part), k, schema)
        scored = found if scored is None else scored.unionByName(found)
    return top_k(scored.withColumn("score", F.round("score", 9)), k)


def _narrow(documents: DataFrame, shared: Broadcast) -> DataFrame:
    """(doc_id, dl, postings): a row for each row with tokens; its different terms, of asked ones, and how often each occurs.

    Terms are places among the asked ones, or token ids where all count. Postings
    are the steps from term to term, then the counts, in bytes of 7 bits.
    """
    named = documents.where(F.col("doc_id").isNotNull()).select("doc_id", T.tokens(F.col("text")).alias("tokens"))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            lists = batch.column("tokens")
            dl = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            row, term = np.repeat(np.arange(len(dl)), dl).astype(np.uint64), T.token_ids(lists.flatten()).astype(np.uint64)
            if asked is not None:
                place = _places(asked, term.astype(np.uint32))
                row, term = row[place >= 0], place[place >= 0].astype(np.uint64)
            # row and term in one number: what is equal stands together
            both, tf = np.unique((row << np.uint64(32)) | term, return_counts=True)
            row, term = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
            sizes = np.bincount(row, minlength=len(dl))
            steps = np.diff(term, prepend=0)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            steps[first] = term[first]
            values = np.zeros(2 * len(both), np.int64)
            at = _first_halves(sizes)
            values[at], values[at + sizes[row]] = steps, tf
            packed, ends = _bytes(values)
            offsets = np.append(0, ends)[2 * np.append(0, np.cumsum(sizes))].astype(np.int64)
            postings = pa.Array.from_buffers(pa.large_binary(), len(dl), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(dl), postings], names=["doc_id", "dl", "postings"]).filter(pa.array(dl > 0))

    return named.mapInArrow(narrow, f"doc_id {dict(documents.dtypes)['doc_id']}, dl bigint, postings binary")


def _places(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each of ``wanted`` stands in sorted ``values``; -1 for none."""
    if not len(values):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return np.where(values[at] == wanted, at, -1)


def _first_halves(sizes: np.ndarray) -> np.ndarray:
    """Places of the first half of each row, where rows of twice ``sizes`` values follow one another."""
    return np.arange(sizes.sum()) + np.repeat(np.cumsum(sizes) - sizes, sizes)


def _bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 to 2**35 as bytes of 7 bits, the lowest first, with the high bit where more follow; and where each number ends."""
    lengths = np.searchsorted(2 ** np.arange(7, 35, 7), values, "right") + 1
    ends = np.cumsum(lengths)
    out = np.zeros(lengths.sum(), np.uint8)
    for i in range(5):
        some = np.flatnonzero(lengths > i)
        out[ends[some] - lengths[some] + i] = ((values[some] >> 7 * i) & 127) | np.where(lengths[some] > i + 1, 128, 0)
    return out, ends


def _numbers(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``_bytes``, and where each ends."""
    ends = np.flatnonzero(packed < 128) + 1
    lengths = np.diff(ends, prepend=0)
    out = np.zeros(len(ends), np.int64)
    for i in range(5):
        some = np.flatnonzero(lengths > i)
        out[some] |= (packed[ends[some] - lengths[some] + i] & 127).astype(np.int64) << 7 * i
    return out, ends


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of compressed lists, see _block, of rows sorted by key; rows of one key are one document. Nothing for no rows."""
    batches = [b for b in batches if len(b)]
    if not batches:
        return
    rows = pa.Table.from_batches(batches).combine_chunks()
    keys = rows["doc_id"].combine_chunks() if rows["doc_id"].num_chunks != 1 else rows["doc_id"].chunk(0)
    try:
        fresh = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False).astype(bool)
    except pa.ArrowNotImplementedError:
        plain = keys.to_pylist()
        fresh = np.array([a != b for a, b in zip(plain, plain[1:])], bool)
    first = np.append(0, np.flatnonzero(fresh) + 1)
    document = np.append(0, np.cumsum(fresh)).astype(np.uint64)
    dl = np.add.reduceat(rows["dl"].to_numpy(), first)
    values, ends = _numbers(np.frombuffer(b"".join(rows["postings"].to_pylist()), np.uint8))
    filled = np.searchsorted(ends, np.append(0, np.cumsum(pc.binary_length(rows["postings"]).to_numpy())), "right")
    sizes = np.diff(filled) // 2
    at = _first_halves(sizes)
    steps, tf = values[at], values[at + np.repeat(sizes, sizes)]
    sums = np.append(0, np.cumsum(steps))
    term = sums[1:] - np.repeat(sums[np.cumsum(sizes) - sizes], sizes)
    both = (term.astype(np.uint64) << np.uint64(32)) | np.repeat(document, sizes)
    order = np.argsort(both, kind="stable")
    both, tf = both[order], tf[order]
    if len(both):
        starts = np.append(0, np.flatnonzero(both[1:] != both[:-1]) + 1)
        both, tf = both[starts], np.add.reduceat(tf, starts)
    terms, df = np.unique(both >> np.uint64(32), return_counts=True)
    steps = np.diff((both & np.uint64(0xFFFFFFFF)).astype(np.int64), prepend=0)
    lists = [keys.take(pa.array(first)), pa.array(dl), pa.array(terms.astype(np.uint32)), pa.array(df), pa.array(steps.astype(np.int32)), pa.array(tf.astype(np.uint32))]
    lists = [pa.LargeListArray.from_arrays(pa.array([0, len(x)], pa.int64()), x) for x in lists]
    batch = pa.RecordBatch.from_arrays(lists, names=["key", "dl", "term", "df", "step", "tf"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block"])


def _block(block: pa.Scalar) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, dl, sorted terms, df, and of each posting by term and document: document, tf) of what _packed gave."""
    batch = pa.ipc.open_stream(block.as_buffer()).read_next_batch()
    keys, *rest = (batch.column(i).flatten() for i in range(batch.num_columns))
    dl, terms, df, steps, tf = (x.to_numpy(zero_copy_only=False) for x in rest)
    return keys, dl, terms, df, np.cumsum(steps, dtype=np.int64), tf.astype(np.int64)


def _counted(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block"):
                _, dl, terms, df, _, _ = _block(block)
                ids = terms if shared.value is None else shared.value[terms]
                columns = [np.append(ids.astype(np.int64), -1), np.append(df, len(dl)), np.append(np.zeros(len(df), np.int64), dl.sum())]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["term_id", "df", "total"])

    return counted


def _scored(blocks: DataFrame, asked: np.ndarray | None, known: DataFrame, k: int, schema: str) -> DataFrame:
    """(query_id, doc_id, score): for each task the k best documents of each query of ``known``, and what ties with the last up to rounding."""
    table = known.select("query_id", "terms", "avgdl").toArrow().combine_chunks()
    lists = table["terms"].combine_chunks()
    flat = lists.flatten()
    term, weight, rarity = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    term = term.astype(np.uint32) if asked is None else _places(asked, term.astype(np.uint32)).astype(np.uint32)
    offsets = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int64)
    avgdl = table["avgdl"][0].as_py() if table.num_rows else 1.0
    shared = blocks.sparkSession.sparkContext.broadcast((table["query_id"].combine_chunks(), offsets, term, weight, rarity, avgdl))
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, offsets, term, weight, rarity, avgdl = shared.value
        none = np.zeros(0, np.int64), np.zeros(0)
        best, floor, all_keys, base = [none] * len(ids), np.full(len(ids), -np.inf), [], 0
        for block in (x for batch in batches for x in batch.column("block")):
            keys, dl, terms, df, document, tf = _block(block)
            raw = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[document] / avgdl))
            place, starts = _places(terms, term), np.append(0, np.cumsum(df))
            begin, end = np.where(place < 0, 0, starts[place]).tolist(), np.where(place < 0, 0, starts[place + 1]).tolist()
            sums = np.zeros(len(dl))
            for q in range(len(ids)):
                at, score = _best(sums, document, raw, weight, rarity, begin, end, offsets[q], offsets[q + 1], k, floor[q])
                if not len(at):
                    continue
                at = at + base
                if len(best[q][0]):
                    at, score = np.concatenate([best[q][0], at]), np.concatenate([best[q][1], score])
                if len(at) >= k:
                    floor[q] = np.partition(score, len(score) - k)[len(score) - k]
                    good = score >= floor[q] - 2e-9
                    at, score = at[good], score[good]
                best[q] = at, score
            all_keys.append(keys)
            base += len(keys)
        if not base:
            return
        keys = pa.concat_arrays(all_keys)
        for start in range(0, len(ids), 4096):
            some = best[start : start + 4096]
            query = start + np.repeat(np.arange(len(some)), [len(at) for at, _ in some])
            at, score = (np.concatenate([b[i] for b in some]) for i in range(2))
            yield from pa.table([ids.take(pa.array(query)), keys.take(pa.array(at)), pa.array(score)], names=arrow.names).cast(arrow).to_batches(65_536)

    return blocks.mapInArrow(score, schema)


def _best(sums: np.ndarray, document: np.ndarray, raw: np.ndarray, weight: np.ndarray, rarity: np.ndarray, begin: list[int], end: list[int], first: int, last: int, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of one query, its terms first ... last-1, of scores not below ``floor``; ``sums`` is all zero before and after."""
    met = [np.zeros(0, np.int64)]
    for j in range(first, last):
        if begin[j] < end[j]:
            at = document[begin[j] : end[j]]
            now = sums[at]
            met.append(at[now == 0])
            sums[at] = now + weight[j] * (rarity[j] * raw[begin[j] : end[j]])
    at = np.concatenate(met)
    score = sums[at]
    sums[at] = 0
    if len(at) and floor > -np.inf:
        good = score >= floor - 2e-9
        at, score = at[good], score[good]
    if len(at) > k:
        # scores are rounded to nine places afterwards
        good = score >= np.partition(score, len(score) - k)[len(score) - k] - 2e-9
        at, score = at[good], score[good]
    if len(at) > 2 * k:
        # of equal scores the first keys decide
        order = np.lexsort((at, -score))
        at, score = at[order], score[order]
        fresh = np.append(True, score[1:] != score[:-1])
        few = np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1] < k
        at, score = at[few], score[few]
    return at, score
