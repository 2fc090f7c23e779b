"""Mixing of sources to target weights by entropy balancing.

Every document i of source s with size w gets a rate r, the expected number of
its copies, that is closest to 1 in relative entropy under the constraints
``sum(r * w over s) = share of s * total`` and ``0 <= r <= max_repeats``. The
solution is an exponential tilt, ``r = min(max_repeats, exp(lambda_s * w / mean
size of s))``; lambda solves the convex dual by Newton steps. The total is an
unknown too: a source that gives less than its share even with all repeats has
no finite multiplier, its documents stay at max_repeats, and the total shrinks
until what it gives leaves the other sources their shares. Spark sums value and
slope of every source over a table of (source, size, documents), made once; only
the few sums of each source come to the driver. A rate becomes copies by rounding
up or down by a draw from a hash of the key.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.splitting import words_in
from siltstone.sources.tables import ensure_checkpoint_dir

#: Bound on the sources of a plan; they are collected and broadcast.
MAX_SOURCES = 1_000
#: Bins of the draws of each source, by their distance from the fractional part.
BINS = 4096
SPACE = r"[ \t\n\r ]+"


def token_count(path: str | None = None):
    """A column function: tokens of a text in the vocabulary file ``path`` (ranks), 0 for null or empty.

    Without a path it takes the public 50k byte-level vocabulary of the machine.
    """

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int32")

    return count


def source_key(column: str = "source") -> Column:
    """The source that a spelling names: trimmed of white space, in lower case."""
    return F.lower(F.regexp_replace(F.col(column), f"^{SPACE}|{SPACE}$", ""))


def sized(documents: DataFrame, size: Column) -> DataFrame:
    """(doc_id, source, size) of the documents that name a source; null sizes count 0."""
    return documents.where("doc_id is not null and source is not null").select("doc_id", source_key().alias("source"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size"))


def word_size() -> Column:
    return words_in("text")


def _tilt(factor: Column, size: Column, mean: Column, cap: Column) -> Column:
    return F.least(cap.cast("double"), F.exp(F.least(factor * size / mean, F.lit(50.0))))


def _sums(histogram: DataFrame, sources: list[dict]) -> dict[str, tuple[float, float]]:
    """source -> (size at its factor, derivative of it by the factor); the derivative is 0 where all documents are at their limit."""
    now = histogram.sparkSession.createDataFrame([(p["source"], p["factor"], p["mean_size"], p["max_repeats"]) for p in sources], "source string, factor double, mean double, cap int")
    size = F.col("size").cast("double")
    rate = _tilt(F.col("factor"), size, F.col("mean"), F.col("cap"))
    slope = F.when(rate < F.col("cap"), F.col("n") * size * size / F.col("mean") * rate).otherwise(0.0)
    return {r["source"]: (r["value"], r["slope"]) for r in histogram.join(F.broadcast(now), "source").groupBy("source").agg(F.sum(F.col("n") * size * rate).alias("value"), F.sum(slope).alias("slope")).collect()}


def _newton(histogram: DataFrame, sources: list[dict], tolerance: float, max_steps: int, only_bracket: bool = False) -> None:
    """Raise ``factor`` and set ``reachable`` of each source with a ``target_size``, all sources in one job a step.

    Newton steps, held within the bracket of factors known to give too little and
    too much. A source with all documents at their limit that still gives too
    little has no finite multiplier and is not reachable. With ``only_bracket``
    a source is done once it gives enough, so that its multiplier is finite.
    """
    for p in sources:
        p["low"], p["high"] = -math.inf, math.inf
    todo = sources
    for _ in range(max_steps):
        if not todo:
            return
        found, still = _sums(histogram, todo), []
        for p in todo:
            (value, slope), at = found[p["source"]], p["factor"]
            miss = p["target_size"] - value
            # sums of whole numbers are exact at the limit; elsewhere the tolerance decides
            if slope == 0 and miss > 0 and at >= 0:
                p["reachable"] = False
                continue
            if (only_bracket and miss <= 0) or abs(miss) <= tolerance * p["target_size"]:
                continue
            p["low"], p["high"] = (at, p["high"]) if miss > 0 else (p["low"], at)
            if p["high"] - p["low"] < 1e-13 * max(1.0, abs(at)):
                continue
            step = at + miss / slope if slope > 0 else math.inf
            if not p["low"] < step < p["high"] or abs(step - at) > 8:
                if math.isinf(p["low"]) or math.isinf(p["high"]):
                    step = at + math.copysign(max(1.0, abs(at)), miss)
                else:
                    step = (p["low"] + p["high"]) / 2
            p["factor"] = step
            still.append(p)
        todo = still


def solve(documents: DataFrame, targets: DataFrame, tolerance: float = 1e-9, max_steps: int = 100, least_total: float = 0.2) -> DataFrame:
    """The plan: one row for each source of ``targets(source, target_share, max_repeats)``.

    ``documents(doc_id, source, size)`` comes from ``sized``; documents of other
    sources do not count. Columns: source, target_share, max_repeats, n_docs,
    size, mean_size, target_size, reachable, factor. A source is reachable if its
    multiplier for its share of the size of all sources is finite. Where one is
    not, all its documents have the rate max_repeats and factor is null, and the
    total is such that all those sources together give the sum of their shares,
    some of them more than their own and others less, but at least the share
    ``least_total`` of the size of all sources; target_size is the share of that
    total. So every reachable source has its share of the mixture, or all have
    theirs in proportion where ``least_total`` holds the total up or nothing comes
    from the others. A source without documents has size 0. Shares that do not
    sum to 1 are taken in proportion. More than MAX_SOURCES targets raise
    ValueError.
    """
    spark = targets.sparkSession
    ensure_checkpoint_dir(spark)
    wanted = targets.where("source is not null").groupBy(source_key().alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    plan = [r.asDict() for r in wanted.limit(MAX_SOURCES + 1).collect()]
    if len(plan) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in the targets")
    histogram = documents.join(F.broadcast(wanted.select("source")), "source", "left_semi").groupBy("source", "size").agg(F.count("*").alias("n")).checkpoint()
    sums = {
        r["source"]: r
        for r in histogram.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum(F.col("n") * F.col("size")).alias("size")).collect()
    }
    total = sum(r["size"] for r in sums.values())
    for p in plan:
        own = sums.get(p["source"])
        p["n_docs"], p["size"] = (own["n_docs"], own["size"]) if own else (0, 0)
        p["target_share"], p["max_repeats"] = float(p["target_share"] or 0), max(0, p["max_repeats"] or 0)
        p["mean_size"] = p["size"] / p["n_docs"] if p["size"] else 1.0
        p["target_size"], p["factor"] = p["target_share"] * total, 0.0
        # without size or repeats there is nothing to tilt
        p["reachable"] = p["target_size"] <= 0 or (p["size"] > 0 and p["max_repeats"] > 0)
    _newton(histogram, [p for p in plan if p["reachable"] and p["target_size"] > 0], tolerance, max_steps, only_bracket=True)
    short = [p for p in plan if not p["reachable"]]
    if given := sum(p["max_repeats"] * p["size"] for p in short):
        total = max(least_total * total, given / sum(p["target_share"] for p in short))
    for p in plan:
        p["target_size"] = p["target_share"] * total
        if not p["reachable"]:
            p["factor"] = None
        elif p["target_size"] <= 0 or not p["size"]:
            p["factor"] = -math.inf
    _newton(histogram, [p for p in plan if p["factor"] is not None and math.isfinite(p["factor"])], tolerance, max_steps)
    rows = [(p["source"], p["target_share"], p["max_repeats"], p["n_docs"], p["size"], p["mean_size"], p["target_size"], p["reachable"], p["factor"]) for p in plan]
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int, n_docs bigint, size bigint, mean_size double, target_size double, reachable boolean, factor double")


def mixture(documents: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, rate, copies) of every document of a planned source.

    A rate is rounded up if a draw from a hash of the key lies under its
    fractional part. Draws that come close are moved for each source together, by
    a cut found in a table of BINS sums for each source, so that the copies meet
    the target up to one bin. ``copies`` is at most max_repeats; documents with 0
    copies are kept as rows.
    """
    size = F.col("size").cast("double")
    rate = F.when(~F.col("reachable"), F.col("max_repeats").cast("double")).otherwise(_tilt(F.col("factor"), size, F.col("mean_size"), F.col("max_repeats")))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))
    few = plan.select("source", "max_repeats", "mean_size", "reachable", "factor")
    rated = documents.join(F.broadcast(few), "source").withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("int"))
    # documents at their limit have no bin; in bins under BINS / 2 the draw lies under the fractional part
    place = F.floor((draw - (F.col("rate") - F.col("whole")) + 1) * (BINS // 2)).cast("int")
    rated = rated.withColumn("bin", F.when(F.col("whole") < F.col("max_repeats"), place))
    sums = rated.groupBy("source", "bin").agg(F.sum("size").alias("up"), F.sum(F.col("size") * F.col("whole")).alias("base"))
    # of each source at most BINS + 1 rows: bins are rounded up in order until the next one would lead further from the target
    of_source = Window.partitionBy("source")
    before = F.sum(F.when(F.col("bin").isNotNull(), F.col("up"))).over(of_source.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("target_size") - F.sum("base").over(of_source) - F.coalesce(before, F.lit(0))
    tried = sums.join(F.broadcast(plan.select("source", "target_size")), "source").select("source", "bin", F.when(gap < F.col("up") / 2, F.col("bin")).alias("stop")).where("bin is not null")
    cuts = tried.groupBy("source").agg(F.coalesce(F.min("stop"), F.max("bin") + 1).alias("cut"))
    return rated.join(F.broadcast(cuts), "source", "left").select(
        "doc_id", "source", "size", "rate", (F.col("whole") + F.when(F.col("bin") < F.col("cut"), 1).otherwise(0)).cast("int").alias("copies")
    )


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """What each source of the plan really reached; sources without documents reach 0."""
    reached = mixed.groupBy("source").agg(F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("size")).alias("mixed_size"))
    total = reached.agg(F.sum("mixed_size").alias("all_size"))
    return (
        plan.join(F.broadcast(reached), "source", "left")
        .crossJoin(F.broadcast(total))
        .select(
            "source", "target_share", "max_repeats", "n_docs", "size", "reachable",
            F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
            F.coalesce("mixed_size", F.lit(0)).alias("mixed_size"),
            F.coalesce(F.col("mixed_size") / F.col("all_size"), F.lit(0.0)).alias("reached_share"),
        )
    )
