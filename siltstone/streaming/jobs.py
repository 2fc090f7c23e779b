"""Background work as Structured Streaming: ingest of arriving pages, latest state of keys, first sight of URLs."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions.urls import url_key
from siltstone.plans.embed import Embedder
from siltstone.plans.ingest import ingest
from siltstone.plans.settings import Settings


def folder(spark: SparkSession, path: str, like: DataFrame, files_a_batch: int | None = None) -> DataFrame:
    """Stream of the Parquet files that arrive in a folder, with the schema of ``like``."""
    reader = spark.readStream.schema(like.schema)
    return (reader if files_a_batch is None else reader.option("maxFilesPerTrigger", files_a_batch)).parquet(path)


def _versions(spark: SparkSession, state: str) -> list[int]:
    """The whole versions under ``state``, by one listing of it and a look into each."""
    root = spark._jvm.org.apache.hadoop.fs.Path(state)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [PurePosixPath(f.getPath().toString()).name for f in files.listStatus(root)]
    return sorted(int(v) for v in names if v.isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{state}/{v}/_SUCCESS")))


def keep_state(stream: DataFrame, state: str, checkpoint: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], keep: int = 2) -> StreamingQuery:
    """Fold every batch into the table under ``state``; each batch writes version ``<batch>`` whole.

    A batch that is run again after a loss reads the version before it, so that
    replays converge. The newest version is the result (see current). Once a
    version is whole, those before the last ``keep`` ones are removed.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, state) if v < number]
        old = spark.read.parquet(f"{state}/{before[-1]}") if before else None
        merge(old, batch).write.mode("overwrite").parquet(f"{state}/{number}")
        for version in before[: max(0, len(before) + 1 - max(2, keep))]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/{version}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, state: str) -> DataFrame:
    """The newest whole version under ``state``."""
    return spark.read.parquet(f"{state}/{_versions(spark, state)[-1]}")


def keep_ingested(pages: DataFrame, state: str, checkpoint: str, embedder: Embedder, settings: Settings = Settings()) -> StreamingQuery:
    """Ingest a stream of ``pages(page_id, url, status_code, html)``: the points under ``state`` are those of the last page of each URL.

    The same pages give the same points in however many batches they arrive, as
    long as the pages of a URL arrive in the order of page_id.
    """
    return keep_state(pages, state, checkpoint, lambda old, new: ingest(old, new, embedder, settings))


def first_seen(stream: DataFrame, at: str, within: str = "1 hour", url: str = "url") -> DataFrame:
    """The first row of each page; keys are forgotten once the watermark has passed ``within``."""
    return stream.withColumn("url_key", url_key(F.col(url))).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, within).dropDuplicatesWithinWatermark(["url_key"])
