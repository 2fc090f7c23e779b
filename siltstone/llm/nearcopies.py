"""Near-duplicate texts by min-max hashing.

A text is the set of its runs of three words. Under each permutation of the
hash space the set keeps its smallest and its largest member, so one evaluation
gives two signature values. Four values (two permutations) make a band key; two
texts that share a key are candidates, and every candidate is checked against
the sets themselves. Texts with equal sets are one class from the start.

Texts are read twice: once for keys and classes, once for the sets of the
candidates. A key shared by many classes never becomes one group: it passes its
task as a stream of small rows and is dealt to pairs of blocks, whose size grows
with the root of the key's, so that n classes become n ** 1.5 / 16 small rows
and not n * n / 256. Every pair of the key meets once; those leave whose
signatures, one bit of each value, agree as well as the threshold lets expect
but for five deviations, which a pair at the threshold misses once in three
million cases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.tables import ensure_checkpoint_dir

WORD = re.compile(r"[^\W_]+")
BANDS, PERMUTATIONS_A_BAND = 40, 2
#: A key with more classes than this goes to pairs of blocks of this size at least.
BLOCK = 256
CANDIDATE, HOT, MEMBER = 0, 1, 2
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)
#: Odd multipliers; multiplication by one permutes the 64-bit numbers.
_PERMUTE = np.random.default_rng(20).integers(1, 2**63, BANDS * PERMUTATIONS_A_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX1
    x = (x ^ (x >> _SHIFT)) * _MIX2
    return x ^ (x >> _SHIFT)


class WordHashes(dict):
    """Hash of each word, kept between texts and dropped when it holds a million words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_sets(texts: list[str | None], hashes: WordHashes, run: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with a set, start of each row's set, hashes of the distinct runs, ordered within each row).

    Null texts and texts under ``run`` words have no set.
    """
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter((hashes[w] for own in words for w in own), dtype=np.uint64, count=int(sizes.sum()))
    if len(flat) < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(flat) - run + 1
    value = np.zeros(n, dtype=np.uint64)
    for k in range(run):
        value = mix(value * np.uint64(31) + flat[k : k + n])
    owner = np.repeat(np.arange(len(words)), sizes)
    whole = owner[:n] == owner[run - 1 :]
    value, owner = value[whole], owner[:n][whole]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    rows, starts = np.unique(owner, return_index=True)
    return rows, starts, value


def classes_of(starts: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; equal sets have equal names."""
    ends = np.append(starts[1:], len(value))
    return mix(np.add.reduceat(mix(value + np.uint64(0x9E3779B97F4A7C15)), starts) ^ mix((ends - starts).astype(np.uint64))).view(np.int64)


def signatures(starts: np.ndarray, value: np.ndarray) -> Iterator[np.ndarray]:
    """Minimum and maximum of each set under one permutation after the other."""
    for odd in _PERMUTE:
        permuted = value * odd
        yield np.minimum.reduceat(permuted, starts)
        yield np.maximum.reduceat(permuted, starts)


def band_keys(starts: np.ndarray, value: np.ndarray) -> Iterator[np.ndarray]:
    each, per = signatures(starts, value), 2 * PERMUTATIONS_A_BAND
    for band in range(BANDS):
        key = np.full(len(starts), band, dtype=np.uint64)
        for _ in range(per):
            key = mix(key * np.uint64(31) + next(each))
        yield key.view(np.int64)


def _members_and_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, class, at): a band key of a class, at null, or a chunk of a class, at its time of arrival."""
    hashes = WordHashes()
    for batch in batches:
        rows, starts, value = shingle_sets(batch.column(1).to_pylist(), hashes)
        if not len(rows):
            continue
        names = classes_of(starts, value)
        ids, at = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
        head = ["key", "class", "at"]
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(names), pa.array(at[rows])], names=head)
        # a class is hashed once in a batch, however often it comes
        _, first = np.unique(names, return_index=True)
        lengths = np.append(starts[1:], len(value)) - starts
        kept = np.concatenate([np.arange(starts[i], starts[i] + lengths[i]) for i in first])
        own = np.concatenate([[0], np.cumsum(lengths[first])[:-1]]).astype(np.int64)
        for key in band_keys(own, value[kept]):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(names[first]), pa.nulls(len(key), pa.int64())], names=head)


def _same_key(key: np.ndarray, own: np.ndarray, hot_key: int | None, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(a, b, CANDIDATE) and (key, class, HOT) over whole keys, ordered by key and class."""
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own = key[fresh], own[fresh]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    for at in np.flatnonzero((sizes > 1) | (key[starts] == hot_key) if hot_key is not None else sizes > 1):
        part = slice(starts[at], starts[at] + sizes[at])
        if sizes[at] > block or key[starts[at]] == hot_key:
            yield key[part], own[part], HOT
        else:
            i, j = np.triu_indices(sizes[at], 1)
            yield own[part][i], own[part][j], CANDIDATE


def _meet(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Over rows (key, class, at) ordered by key and class: the classes that share a key.

    Gives (a, b, CANDIDATE), and for a key with more than ``block`` classes
    (key, class, HOT) instead; rows of members pass as (chunk_id, class, MEMBER).
    At most one batch and the open key are held.
    """
    names, hot_key = ["a", "b", "kind", "at"], None
    carry_key, carry_class = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(found: list[tuple[np.ndarray, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
        if found:
            a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
            kind = np.repeat(np.array([x[2] for x in found], np.int32), [len(x[0]) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(kind), pa.nulls(len(a), pa.int64())], names=names)

    for batch in batches:
        is_member = batch.column(2).is_valid()
        own = batch.filter(is_member)
        if len(own):
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(np.full(len(own), MEMBER, np.int32)), own.column(2)], names=names)
        keys = batch.filter(pa.compute.invert(is_member))
        key = np.concatenate([carry_key, keys.column(0).to_numpy(zero_copy_only=False)])
        own = np.concatenate([carry_class, keys.column(1).to_numpy(zero_copy_only=False)])
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1], "left"))
        if last == 0 and len(key) > 4 * block:
            # one key fills all that is held: it is hot, and what is held can go
            hot_key = int(key[-1])
            yield from rows([(key, own, HOT)])
            carry_key, carry_class = key[:0], own[:0]
            continue
        yield from rows(list(_same_key(key[:last], own[:last], hot_key, block)))
        carry_key, carry_class = key[last:], own[last:]
    yield from rows(list(_same_key(carry_key, carry_class, hot_key, block)))


def _sets(with_bits: bool):
    """Rows (class, runs) of 32-bit run hashes, and with ``with_bits`` one bit of each signature value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows, starts, value = shingle_sets(batch.column(0).to_pylist(), hashes)
            if not len(rows):
                continue
            names = classes_of(starts, value)
            _, first = np.unique(names, return_index=True)
            if with_bits:
                bits = np.stack([(s >> np.uint64(17)) & np.uint64(1) for s in signatures(starts, value)], axis=1).astype(np.uint8)
                packed = np.packbits(bits, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(names[first]), pa.array([packed[i].tobytes() for i in first], pa.binary())], names=["class", "bits"])
            else:
                offsets = pa.array(np.append(starts, len(value)).astype(np.int32))
                runs = pa.ListArray.from_arrays(offsets, pa.array((value & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(names), runs], names=["class", "runs"]).take(pa.array(first))

    return run


def _within_blocks(hot: DataFrame, texts: DataFrame, threshold: float, block: int) -> DataFrame:
    """Candidates (a, b) among the classes of hot keys, by pairs of blocks.

    A key of n classes has sqrt(n / block) blocks; a pair of blocks meets in one
    task. Pairs pass if the share of equal signature bits is not more than five
    deviations under what the threshold leads to expect.
    """
    sizes = hot.groupBy("key").agg(F.ceil(F.sqrt(F.count("*") / block)).cast("int").alias("blocks"))
    bits = texts.mapInArrow(_sets(True), "class bigint, bits binary").groupBy("class").agg(F.max("bits").alias("bits"))
    placed = hot.join(sizes, "key").join(bits, "class").withColumn("mine", F.pmod(F.xxhash64("class", "key"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "class", "bits"
    )
    n = 2 * BANDS * PERMUTATIONS_A_BAND
    expected = (1 + threshold) / 2
    least = n * expected - 5 * (n * expected * (1 - expected)) ** 0.5

    def compare(group: pa.Table) -> pa.Table:
        own, mine = group["class"].to_numpy(), group["mine"].to_numpy()
        if not len(own):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        signs = np.unpackbits(np.stack([np.frombuffer(x, np.uint8) for x in group["bits"].to_pylist()]), axis=1)[:, :n].astype(np.float32) * 2 - 1
        left, right = (np.flatnonzero(mine == k) for k in (i, j))
        a, b = [], []
        for at in range(0, len(left), block):
            part = left[at : at + block]
            x, y = np.nonzero((signs[part] @ signs[right].T + n) / 2 >= least)
            a.append(own[part[x]]), b.append(own[right[y]])
        a, b = np.concatenate(a) if a else own[:0], np.concatenate(b) if b else own[:0]
        return pa.table({"a": np.minimum(a, b)[a != b], "b": np.maximum(a, b)[a != b]})

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def near_copies(chunks: DataFrame, threshold: float = 0.6, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Members (chunk_id, class) and links (a, b, similarity) between classes, a < b.

    ``chunks(chunk_id, text, loaded_at)``; each chunk counts in its last loaded
    delivery, ties in the delivery time go to the greater class. Chunks of one
    class have equal sets of runs. Null and empty texts and those under three
    words belong to no class. Candidates of exact similarity 0.6 are met with
    probability 0.996, of 0.7 with 0.99999; every link is verified. Sets are
    compared by 32-bit, classes by 64-bit hashes.
    """
    ensure_checkpoint_dir(chunks.sparkSession)
    texts = chunks.where("chunk_id is not null and text is not null")
    arrived = F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(-(1 << 62)))
    met = (
        texts.select("chunk_id", "text", arrived)
        .mapInArrow(_members_and_keys, "key bigint, class bigint, at bigint")
        .repartition("key")
        .sortWithinPartitions("key", "class")
        .mapInArrow(lambda batches: _meet(batches, block), "a bigint, b bigint, kind int, at bigint")
        .checkpoint()
    )
    members = met.where(F.col("kind") == MEMBER).groupBy(F.col("a").alias("chunk_id")).agg(F.max(F.struct("at", "b")).getField("b").alias("class"))
    candidates = met.where(F.col("kind") == CANDIDATE).select("a", "b")
    hot = met.where(F.col("kind") == HOT).select(F.col("a").alias("key"), F.col("b").alias("class")).distinct()
    if not hot.isEmpty():
        candidates = candidates.unionByName(_within_blocks(hot, texts.select("text"), threshold, block))
    candidates = candidates.distinct()
    involved = candidates.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    sets = (
        texts.select("text")
        .mapInArrow(_sets(False), "class bigint, runs array<int>")
        .join(involved, "class", "left_semi")
        .groupBy("class")
        .agg(F.first("runs").alias("runs"))
        .checkpoint()
    )
    both = candidates.join(sets.select(F.col("class").alias("a"), F.col("runs").alias("runs_a")), "a").join(
        sets.select(F.col("class").alias("b"), F.col("runs").alias("runs_b")), "b"
    )
    shared = F.size(F.array_intersect("runs_a", "runs_b"))
    links = both.select("a", "b", shared.alias("shared"), (F.size("runs_a") + F.size("runs_b")).alias("sizes")).select(
        "a", "b", (F.col("shared") / (F.col("sizes") - F.col("shared"))).alias("similarity")
    )
    return members, links.where(F.col("similarity") >= threshold)


def pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(chunk_a, chunk_b) with chunk_a < chunk_b: all chunks of one class and of linked classes."""
    one, two = members.select(F.col("chunk_id").alias("x"), F.col("class").alias("a")), members.select(F.col("chunk_id").alias("y"), F.col("class").alias("b"))
    across = links.select("a", "b").join(one, "a").join(two, "b").select(F.least("x", "y").alias("chunk_a"), F.greatest("x", "y").alias("chunk_b"))
    several = members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select(F.col("class").alias("a"))
    copies = one.join(several, "a", "left_semi")
    within = copies.select(F.col("x").alias("chunk_a"), "a").join(copies.select(F.col("x").alias("chunk_b"), "a"), "a").where("chunk_a < chunk_b").select("chunk_a", "chunk_b")
    return across.unionByName(within)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that a node is linked to over any number of links.

    Each round takes the smallest label among neighbours and then the label of
    that label; rounds end when nothing changes. Labels are checkpointed.
    """
    ensure_checkpoint_dir(links.sparkSession)
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    labels = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("component")).checkpoint()
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        jump = lower.join(labels.select(F.col("node").alias("low"), F.col("component").alias("beyond")), "low", "left")
        moved = jump.select("node", F.least("low", F.coalesce("beyond", "low")).alias("component"), "old").checkpoint()
        labels = moved.select("node", "component")
        if moved.where("component <> old").isEmpty():
            break
    return labels


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each chunk with a class: its class_id and group_id, the number of linked other classes and of copies.

    A class is named by its smallest chunk_id, a group by that of all its chunks.
    Only classes that some chunk has in its last delivery count.
    """
    ensure_checkpoint_dir(members.sparkSession)
    classes = members.groupBy("class").agg(F.min("chunk_id").alias("class_id"), F.count("*").alias("n_copies"))
    live = links.select("a", "b").join(classes.select(F.col("class").alias("a")), "a", "left_semi").join(classes.select(F.col("class").alias("b")), "b", "left_semi").checkpoint()
    degree = live.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    linked = classes.join(components(live).withColumnRenamed("node", "class"), "class", "left").join(degree, "class", "left")
    firsts = linked.where("component is not null").groupBy("component").agg(F.min("class_id").alias("group_id"))
    told = linked.join(firsts, "component", "left").select("class", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.join(told, "class").select("chunk_id", "class_id", "group_id", "n_copies", "n_links")
