"""Exact top-k by cosine similarity: groups of queries go to where the rows are read."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from siltstone.operators.sparse import top_k
from siltstone.sources.tables import ensure_checkpoint_dir

#: Rows that a group of queries meets at once, and numbers in the vectors of a group, which is sent to every task, and in its results of a task.
BLOCK, NUMBERS = 4096, 2_097_152


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision over their common length; 0 where one has no length, null for null."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.arrays_zip(F.slice(a, 1, n).alias("x"), F.slice(b, 1, n).alias("y"))
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + f(p["x"].cast("double"), p["y"].cast("double")))
    norms = F.sqrt(total(lambda x, _: x * x)) * F.sqrt(total(lambda _, y: y * y))
    return F.when(a.isNull() | b.isNull(), None).when(n == 0, 0.0).when(norms == 0, 0.0).otherwise(total(lambda x, y: x * y) / norms)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def search(queries: DataFrame, rows: DataFrame, k: int = 10, by: list[str] | None = None, least: float | None = None, include_self: bool = True) -> DataFrame:
    """(query_id, row_id, score, rank): the k rows most similar to each query.

    ``queries(query_id, vector, *by)`` and ``rows(row_id, vector, *by)``; a query
    meets the rows that agree with it in the columns ``by`` (null agrees with
    null). ``least`` keeps similarities of at least so much, and applies before
    the cut at k. Ties go to the smaller row_id. Null and empty vectors and those
    with null members take no part, vectors of different lengths never meet; a
    vector of zeros has similarity 0.

    No vector is shuffled: a task keeps the best rows of each query of a group
    while its own rows pass. Of rows that tie it keeps no more than can be among
    the k, so that a vector of zeros, which ties with every row, needs no more room.
    """
    by = by or []
    spark = queries.sparkSession
    ensure_checkpoint_dir(spark)
    usable = "vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x))"
    kind = F.xxhash64(F.size("vector"), *[x for c in by for x in (F.col(c).isNull(), F.col(c))]).alias("kind")
    of_q = max(1, queries.count())
    numbered = F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(1 << 30)).alias("part")
    q = queries.where(usable).select("query_id", F.col("vector").cast("array<double>"), kind, numbered).checkpoint()
    widest = q.agg(F.max(F.size("vector"))).head()[0] or 1
    n_groups = -(-of_q * max(widest, k + 1) // NUMBERS)
    rows = rows.where(usable).select("row_id", F.col("vector").cast("array<double>"), kind)
    cores = spark.sparkContext.defaultParallelism
    if n_groups > 1:
        rows = rows.checkpoint()
    parts = rows.rdd.getNumPartitions()
    rows = rows.coalesce(cores) if parts > cores else rows
    schema = f"query_id {dict(queries.dtypes)['query_id']}, row_id {dict(rows.dtypes)['row_id']}, score double"
    met = None
    for part in range(n_groups):
        found = _met(rows, q.where(F.col("part") % n_groups == part), k, -2.0 if least is None else least, include_self, schema)
        met = found if met is None else met.unionByName(found)
    return top_k(met, k, key="row_id")


def _rounded(scores: np.ndarray) -> np.ndarray:
    """Rounded to nine places, halves away from zero, as Spark's round has it."""
    scaled = np.abs(scores) * 1e9
    whole = np.floor(scaled)
    part = scaled - whole
    out = np.copysign((whole + (part >= 0.5)) / 1e9, scores)
    # so near a half that the product may be on the wrong side
    near = np.abs(part - 0.5) < 1e-5
    if near.any():
        values, at = np.unique(scores[near], return_inverse=True)
        out[near] = np.array([float(Decimal(repr(v)).quantize(Decimal("1e-9"), ROUND_HALF_UP)) for v in values.tolist()])[at]
    return out + 0.0


def _order(ids: pa.Array) -> np.ndarray | None:
    """The places of sorted ids, null first; None for types that Arrow does not sort."""
    try:
        return pc.sort_indices(ids, null_placement="at_start").to_numpy().astype(np.int64)
    except pa.ArrowNotImplementedError:
        return None


def _first(scores: np.ndarray, depth: int, sorted_ids: bool) -> np.ndarray:
    """Which columns are among the ``depth`` greatest rounded scores of each row; of ties the first ones if they stand in the order of their ids, else all."""
    last = np.partition(scores, scores.shape[1] - depth, axis=1)[:, scores.shape[1] - depth, None]
    good = scores >= last - 2e-9
    many = np.flatnonzero(good.sum(axis=1) > 2 * depth)
    if len(many) and sorted_ids:
        rounded = _rounded(scores[many])
        last = _rounded(last[many])
        good[many], ties = rounded > last, rounded == last
        good[many] |= ties & (np.cumsum(ties, axis=1, dtype=np.int32) <= depth - good[many].sum(axis=1)[:, None])
    return good


def _dots(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows i of x with the rows j of y, a few at a time."""
    step = max(1, 2**19 // x.shape[1])
    return np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", x[i[n : n + step]], y[j[n : n + step]]) for n in range(0, len(i), step)]])


def _met(rows: DataFrame, asked: DataFrame, k: int, floor: float, include_self: bool, schema: str) -> DataFrame:
    """(query_id, row_id, score): for each task the rows that may be among the k best of each query of ``asked``."""
    table = asked.select("query_id", "vector", "kind").toArrow().combine_chunks()
    shared = rows.sparkSession.sparkContext.broadcast(table)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)])
    # one more than k, for the row itself
    depth = k + 1

    def unit(vectors: pa.Table) -> np.ndarray:
        m = _matrix(vectors["vector"])
        size = np.linalg.norm(m, axis=1)
        return m / np.where(size == 0, 1, size)[:, None]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        kinds = table["kind"].to_numpy()
        known, twins = {}, {}
        for one in np.unique(kinds).tolist():
            own = np.flatnonzero(kinds == one)
            x = unit(table.take(pa.array(own)))
            # vectors of zeros have the same rows: the first one stands for all
            zeros = np.flatnonzero(~x.any(axis=1))
            if len(zeros) > 1:
                twins[own[zeros[0]]] = own[zeros[1:]]
                own, x = np.delete(own, zeros[1:]), np.delete(x, zeros[1:], axis=0)
            known[one] = own, x, x.astype(np.float32)
        edge = np.full(len(kinds), floor)
        ids, query, row, best = None, np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        new_ids: list[pa.Array] = []
        n_ids = count = 0
        # taken once, as taking it costs more than what is done in it
        room = np.empty(256 * BLOCK, np.float32), np.empty(256 * BLOCK, bool)

        def settle() -> None:
            nonlocal ids, query, row, best, n_ids, count
            every = pa.concat_arrays([*([ids] if ids is not None else []), *new_ids])
            places = _order(every)
            query, row, best = (np.concatenate([old, *[w[i] for w in waiting]]) for i, old in enumerate((query, row, best)))
            order = np.lexsort((-best, query) if places is None else (np.argsort(places)[row], -best, query))
            query, row, best = query[order], row[order], best[order]
            begin = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(begin, len(query)))
            full = begin[sizes >= depth]
            # what ties with the last one up to rounding is looked at
            edge[query[full]] = np.maximum(floor, best[full + depth - 1] - 2e-9)
            good = best >= edge[query] if places is None else np.arange(len(query)) - np.repeat(begin, sizes) < depth
            query, row, best = query[good], row[good], best[good]
            used, row = np.unique(row, return_inverse=True)
            ids, row = every.take(pa.array(used)), row.astype(np.int32)
            waiting.clear(), new_ids.clear()
            n_ids, count = len(ids), 0

        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                own = pa.Table.from_batches([batch.slice(start, BLOCK)]).combine_chunks()
                order = _order(own["row_id"].combine_chunks())
                own = own if order is None else own.take(pa.array(order)).combine_chunks()
                of_row = own["kind"].to_numpy()
                new_ids.append(own["row_id"].combine_chunks())
                for one in np.unique(of_row).tolist():
                    if one not in known:
                        continue
                    (asking, x, narrow), at = known[one], np.flatnonzero(of_row == one)
                    y = unit(own.take(pa.array(at)))
                    # single precision chooses, double precision decides; products of unit vectors err by less than this
                    y_narrow, slack = y.astype(np.float32), (y.shape[1] + 8) * 1.2e-7
                    for begin in range(0, len(asking), 256):
                        some = asking[begin : begin + 256]
                        shape = len(some), len(at)
                        score, near = (r[: shape[0] * shape[1]].reshape(shape) for r in room)
                        np.matmul(narrow[begin : begin + 256], y_narrow.T, out=score)
                        np.greater_equal(score, (edge[some] - slack).astype(np.float32)[:, None], out=near)
                        many = np.flatnonzero(near.sum(axis=1) > 2 * depth)
                        if len(many):
                            near[many] &= _first(x[begin + many] @ y.T, depth, order is not None)
                        i, j = np.divmod(np.flatnonzero(near), len(at))
                        score = _dots(x, begin + i, y, j)
                        good = score >= edge[some[i]]
                        i, j, score = i[good], j[good], score[good]
                        waiting.append((some[i].astype(np.int32), (n_ids + at[j]).astype(np.int32), _rounded(score)))
                        count += len(i)
                n_ids += len(own)
                if count > max(65_536, len(kinds) * depth):
                    settle()
        if new_ids:
            settle()
        for one, others in twins.items():
            at = np.flatnonzero(query == one)
            query = np.append(query, np.repeat(others, len(at)))
            row, best = (np.append(v, np.tile(v[at], len(others))) for v in (row, best))
        for start in range(0, len(query), 65_536):
            part = slice(start, start + 65_536)
            out = pa.table([table["query_id"].combine_chunks().take(pa.array(query[part])), ids.take(pa.array(row[part])), pa.array(best[part])], names=arrow.names)
            if not include_self:
                out = out.filter(pa.array([a != b for a, b in zip(out["query_id"].to_pylist(), out["row_id"].to_pylist())], pa.bool_()))
            yield from out.cast(arrow).combine_chunks().to_batches()

    return rows.mapInArrow(meet, schema)
