"""Upserts, deletes and replacement of points, crawl state, jobs and caches, each as one DataFrame result.

Files have no row updates: a new state is the old one without the touched keys,
together with the new rows, and is written beside the old one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.tables import free_name

DEFAULT_TTL = 3600


def last_in_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order``; equal orders by a hash of the row. Null keys are dropped."""
    place = free_name(rows, "place")
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    return rows.where(F.col(key).isNotNull()).withColumn(place, F.row_number().over(w)).where(F.col(place) == 1).drop(place)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Old rows whose key is not in ``new``, and the last new row of each key; columns missing on one side are null."""
    fresh = last_in_order(new, key, order)
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def delete_by(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``keys``; null keys stay, no keys delete nothing."""
    return old.join(keys.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def replace_by_url(old: DataFrame, new: DataFrame, order: str, key: str = "point_id") -> DataFrame:
    """Ingest again: all old points of the URLs that ``new`` has points for go, the new ones come."""
    urls = new.where("url is not null and url <> ''").select("url")
    return upsert(delete_by(old, urls, "url"), new, key, order)


def payload_filter(rows: DataFrame, wanted: dict[str, object], extra: str = "extra") -> DataFrame:
    """Rows equal in every wanted key: a column if there is one, else a key of the map ``extra``. None and {} filter nothing."""
    if not wanted:
        return rows

    def equal(name: str, value: object) -> Column:
        column = F.col(f"`{name}`") if name in rows.columns else F.try_element_at(F.col(extra), F.lit(name))
        return column == F.lit(value)

    return rows.where(reduce(lambda a, b: a & b, [equal(n, v) for n, v in wanted.items()]))


def crawl_state(log: DataFrame, key: str = "url_hash", at: str = "updated_at") -> DataFrame:
    """State of each URL from a log of state changes.

    The last change gives status, http_status and error; crawled_at is its time
    if the status is crawled or failed, else null; url and created_at stay from
    the first change.
    """
    last = F.max_by(F.struct("status", "http_status", "error", F.col(at).alias("changed_at")), F.struct(at, "status"))
    merged = log.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("last"), F.min_by("url", F.struct(at, "url")).alias("url"), F.min(at).alias("created_at"))
    return merged.select(
        key, "url", "last.status", "last.http_status", F.when(F.col("last.status").isin("crawled", "failed"), F.col("last.changed_at")).alias("crawled_at"),
        "last.error", "created_at", F.col("last.changed_at").alias("updated_at"),
    )


def job_state(log: DataFrame) -> DataFrame:
    """Jobs from a log (job_id, job_type, status, result, error, at): the last change wins, an empty result is null."""
    last = F.max_by(F.struct("status", F.when(~F.col("result").isin("", "{}", "[]"), F.col("result")).alias("result"), "error", F.col("at").alias("updated_at")), F.struct("at", "status"))
    merged = log.where("job_id is not null").groupBy("job_id").agg(F.min_by("job_type", "at").alias("job_type"), last.alias("last"), F.min("at").alias("created_at"))
    return merged.select("job_id", "job_type", "last.*", "created_at")


def written(entries: DataFrame, default_ttl: int = DEFAULT_TTL) -> DataFrame:
    """Cache entries with expires_at; a ttl of null or 0 is the default one."""
    ttl = F.when(F.coalesce("ttl", F.lit(0)) == 0, default_ttl).otherwise(F.col("ttl"))
    return entries.withColumn("expires_at", F.timestamp_micros(F.unix_micros(F.col("written_at").cast("timestamp")) + ttl.cast("bigint") * 1_000_000))


def cache_lookup(reads: DataFrame, entries: DataFrame, key: str = "key", slice_seconds: int = 3_600) -> DataFrame:
    """``reads(read_id, key, read_at)`` with the value of the last entry written before and not expired, and ``hit``.

    One row for each read. A later write hides an earlier one even if it has
    expired. Both are merged along time, so that a hot key needs no pairs of
    reads and writes; and its time is cut into slices of ``slice_seconds``, so that
    no task holds all of it. What the slices before one leave is carried over by a
    table with one row for each key and slice. Null keys agree with each other;
    a read without time finds nothing.
    """
    reads_at = reads.where("read_at is not null").select(F.col("read_id"), F.col(key), F.col("read_at").cast("timestamp").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(dict(entries.dtypes)["value"]).alias("value"), F.lit(None).cast("timestamp").alias("expires_at"))
    writes_at = entries.where("written_at is not null").select(F.lit(None).cast(dict(reads.dtypes)["read_id"]).alias("read_id"), F.col(key), F.col("written_at").cast("timestamp").alias("at"), F.lit(0).alias("side"), "value", F.col("expires_at").cast("timestamp"))
    every = reads_at.unionByName(writes_at).withColumn("slice", F.floor(F.unix_seconds("at") / slice_seconds))
    entry = F.when(F.col("side") == 0, F.struct("value", "expires_at"))
    w = Window.partitionBy(key, "slice").orderBy("at", "side", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = every.withColumn("entry", F.last(entry, ignorenulls=True).over(w)).where("side = 1")
    ends = every.groupBy(key, "slice").agg(F.max_by(entry, F.when(F.col("side") == 0, F.struct("at", "value"))).alias("last"))
    before = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(key).alias("of_key"), F.col("slice").alias("of_slice"), F.last("last", ignorenulls=True).over(before).alias("carried"))
    joined = merged.join(carried, F.col(key).eqNullSafe(F.col("of_key")) & (F.col("slice") == F.col("of_slice")), "left").withColumn("entry", F.coalesce("entry", "carried"))
    hit = F.coalesce(F.col("entry.expires_at") > F.col("at"), F.lit(False))
    found = joined.select("read_id", key, F.when(hit, F.col("entry.value")).alias("value"), hit.alias("hit"))
    timeless = reads.where("read_at is null").select("read_id", key, F.lit(None).cast(dict(entries.dtypes)["value"]).alias("value"), F.lit(False).alias("hit"))
    return found.unionByName(timeless)


def health(services: DataFrame) -> DataFrame:
    """One row (status, n_up, n_down): healthy if all of (service, up) are up, unhealthy if none, else degraded."""
    up, n = F.count_if(F.coalesce("up", F.lit(False))), F.count("*")
    return services.agg(F.when(up == n, "healthy").when(up == 0, "unhealthy").otherwise("degraded").alias("status"), up.alias("n_up"), (n - up).alias("n_down"))
