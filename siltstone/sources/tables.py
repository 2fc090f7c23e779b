"""Reading of the Parquet tables, and the rule that a repeated delivery counts once."""

from __future__ import annotations

import os
import re
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits of a filter of keys at most; beyond 33 million keys it lets more rows pass.
FILTER_BITS = 2**28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever extra columns it carries."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def latest(df: DataFrame, key: str, order: str = "loaded_at", heavy: bool = False) -> DataFrame:
    """One row for each key: the one with the greatest ``order`` (nulls last).

    ``heavy`` says that costly work by row follows: the rows are then spread over
    all cores, and small partitions are not merged.

    Equal ``order`` values are decided by a hash of the whole row, so that a
    rerun gives the same row. Rows whose key is null have no identity and are
    dropped. An empty table stays empty.
    """
    rank = free_name(df, "rank_in_key")
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), row_hash)
    if heavy:
        spark = df.sparkSession
        df = df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)
    return df.where(F.col(key).isNotNull()).withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine takes a temporary folder of its
    own; on a cluster, where such a folder would not be shared, ValueError.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer partitions than there are, for work that is heavy by row.

    So few partitions mean a small table; a large one is left as it is read,
    without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def among(df: DataFrame, key: str, held: DataFrame) -> DataFrame:
    """``df`` without most of the rows whose ``key`` is not in ``held``, told where they are read, so that a join after it shuffles few of them.

    It is a filter of bits (Bloom): rows of all keys of ``held`` stay, and one or two in a
    hundred of the others. ``held`` is read twice. Keys are equal only in the same type.
    """
    bits = 1 << max(10, (16 * held.count()).bit_length())
    bits = min(bits, FILTER_BITS)
    places = held.select(F.xxhash64(F.col(key).cast(df.schema[key].dataType)).alias("h")).select(F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 32))).alias("h")).select(F.col("h").bitwiseAND(bits - 1).alias("h"))
    words = places.groupBy(F.shiftright("h", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
    filled = np.zeros(bits // 64, np.uint64)
    filled[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    shared = df.sparkSession.sparkContext.broadcast(filled)

    @F.pandas_udf("boolean")
    def known(hashes: pd.Series) -> pd.Series:
        h, filled = hashes.to_numpy().view(np.uint64), shared.value
        found = np.ones(len(h), bool)
        for x in (h, h >> np.uint64(32)):
            at = x & np.uint64(bits - 1)
            found &= (filled[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return pd.Series(found)

    return df.where(known(F.xxhash64(F.col(key))))
