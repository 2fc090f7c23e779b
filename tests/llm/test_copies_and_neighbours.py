import re
import tracemalloc
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import nearcopies, neighbours

T0 = datetime(2030, 1, 1)


def sets(texts):
    out = {}
    for k, t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        out[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    return {k: s for k, s in out.items() if s}


def brute(texts, threshold=0.6):
    own = sets(texts)
    return {(a, b) for a in own for b in own if a < b and len(own[a] & own[b]) / len(own[a] | own[b]) >= threshold}


def make(rng, n, edits):
    vocabulary = [f"w{i}" for i in range(400)]
    base = list(rng.choice(vocabulary, 60))
    out = []
    for _ in range(n):
        own = base[:]
        for at in rng.integers(0, 60, edits):
            own[at] = rng.choice(vocabulary)
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def chunk_rows():
    rng = np.random.default_rng(3)
    texts = [t for _ in range(12) for t in make(rng, 6, 2)]
    texts += ["Exact, copy of this!", "exact copy OF this", "exact copy of this", None, "", "two words", "one two three", "One_two three"]
    return list(enumerate(texts))


def table(spark, rows):
    return spark.createDataFrame([(k, t, T0, "extra") for k, t in rows], "chunk_id bigint, text string, loaded_at timestamp, class string")


def test_pairs_against_brute_force(spark, chunk_rows):
    got = {tuple(r) for r in nearcopies.pairs(*nearcopies.near_copies(table(spark, chunk_rows))).collect()}
    want = brute(chunk_rows)
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 50


@pytest.mark.parametrize("block", [2, 8])
def test_hot_keys_take_the_way_over_blocks(spark, block):
    rows = list(enumerate(make(np.random.default_rng(5), 40, 1)))
    got = [tuple(r) for r in nearcopies.pairs(*nearcopies.near_copies(table(spark, rows), block=block)).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.97 * len(want) and len(want) > 300


def test_hot_keys_of_unlike_texts_give_no_pairs(spark):
    # texts that share a long frame meet under hot keys, but are not alike beyond it
    rng = np.random.default_rng(6)
    frame = " ".join(f"f{i}" for i in range(30))
    rows = [(i, frame + " " + " ".join(f"w{n}" for n in rng.integers(0, 10**6, 40))) for i in range(60)] + [(100 + i, t) for i, t in enumerate(make(rng, 20, 1))]
    got = [tuple(r) for r in nearcopies.pairs(*nearcopies.near_copies(table(spark, rows), block=4)).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.97 * len(want) and len(want) > 50


def test_last_delivery_and_groups(spark):
    rows = [(1, "a b c d e f g h", T0), (2, "a b c d e f g h i", T0), (3, "z y x w v", T0), (3, "a b c d e f g h", T0 + timedelta(1)), (4, "q r s t", T0), (None, "q r s t", T0)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, text string, loaded_at timestamp")
    members, links = nearcopies.near_copies(chunks)
    assert {tuple(r) for r in nearcopies.pairs(members, links).collect()} == {(1, 2), (1, 3), (2, 3)}
    groups = {r.chunk_id: r for r in nearcopies.groups(members, links).collect()}
    assert groups[1].group_id == groups[2].group_id == groups[3].group_id != groups[4].group_id
    assert (groups[1].n_copies, groups[1].n_links, groups[4].n_links) == (2, 1, 0)
    empty = nearcopies.near_copies(chunks.limit(0))
    assert nearcopies.pairs(*empty).count() == 0 and nearcopies.groups(*empty).count() == 0


def test_groups_count_live_classes_only(spark):
    base = [f"w{i}" for i in range(40)]
    one, two = " ".join(base), " ".join([*base[:12], "x", "y", "z", *base[12:30], "p", "q"])
    between = " ".join([*base[:12], "x", *base[12:33]])
    rows = [(1, one, T0), (2, two, T0), (3, between, T0), (3, "something else altogether now", T0 + timedelta(1))]
    assert brute([(1, one), (2, two), (3, between)]) == {(1, 3), (2, 3)}
    groups = {r.chunk_id: (r.class_id, r.group_id, r.n_copies, r.n_links) for r in nearcopies.groups(*nearcopies.near_copies(spark.createDataFrame(rows, "chunk_id bigint, text string, loaded_at timestamp"))).collect()}
    assert groups == {1: (1, 1, 1, 0), 2: (2, 2, 1, 0), 3: (3, 3, 1, 0)}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1, 1.0) for i in range(0, 20)] + [(100, 101, 1.0)], "a bigint, b bigint, similarity double")
    got = {r.node: r.component for r in nearcopies.components(links).collect()}
    assert Counter(got.values()) == {0: 21, 100: 2}


def exact(vectors, collections, k, least):
    out = {}
    for i, x in vectors.items():
        score = [(-float(x @ y), j) for j, y in vectors.items() if j != i and collections[i] == collections[j] and x @ y >= least]
        out[i] = [j for _, j in sorted(score)[:k]]
    return out


def chunk_vectors(spark, x, collections, extra=()):
    rows = [(i, collections[i], [float(v) for v in x[i]], T0, 1) for i in range(len(x))] + list(extra)
    return spark.createDataFrame(rows, "chunk_id bigint, collection string, embedding array<float>, loaded_at timestamp, h1 int")


def test_neighbours_small_are_exact(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 8)).astype(np.float32)
    x[5:40] = x[4]
    collections = [("a", "b", None)[i % 3] for i in range(80)]
    bad = [(200, "a", None, T0, 1), (201, "a", [1.0] * 4, T0, 1), (202, "a", [0.0] * 8, T0, 1), (203, "a", [float("nan")] * 8, T0, 1), (204, "a", [None] * 8, T0, 1), (0, "a", [float(v) for v in x[0]], T0 + timedelta(1), 1)]
    got = {}
    for r in neighbours.neighbours(chunk_vectors(spark, x, collections, bad), k=5, width=8).orderBy("chunk_id", "position").collect():
        got.setdefault(r.chunk_id, []).append(r.neighbour_id)
    unit = neighbours.unit(x)
    want = exact(dict(enumerate(unit)), collections, 5, -2)
    # equal vectors tie exactly; their cosines must be equal too
    assert got == want


@pytest.mark.parametrize("block", [None, 60])
def test_tree_recall(spark, monkeypatch, block):
    # a sample of a tenth: most neighbours are unknown to the calibration; small blocks split members and visitors of a leaf
    monkeypatch.setattr(neighbours, "LEAST_SAMPLE", 300)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + 0.35 * rng.normal(size=(3000, 16))).astype(np.float32)
    collections = ["a" if i % 5 else "b" for i in range(3000)]
    near = neighbours.neighbours(chunk_vectors(spark, x, collections), k=10, width=16, least=0.85, recall=0.985, block=block)
    rows = near.select("chunk_id", "neighbour_id").collect()
    got = {(r.chunk_id, r.neighbour_id) for r in rows}
    unit = neighbours.unit(x)
    score = unit @ unit.T
    score[np.array(collections)[:, None] != np.array(collections)[None, :]] = -1
    np.fill_diagonal(score, -1)
    want = {(i, int(j)) for i in range(3000) for j in np.argsort(-score[i], kind="stable")[:10] if score[i, j] >= 0.85}
    assert len(rows) == len(got) and len(want) > 1000 and len(got & want) >= 0.97 * len(want)


def test_traversal_is_best_bin_first():
    x = neighbours.unit(np.random.default_rng(9).normal(size=(2000, 12)))
    tree = neighbours.fit(x)
    n_leaves = int((tree.first == tree.last).sum())
    row, leaf, gap = tree.visits(x[:50], np.inf)
    for i in range(50):
        own = gap[row == i]
        assert len(own) == n_leaves == len(set(leaf[row == i])) and own[0] == 0 and (np.diff(own) >= 0).all()
    # a margin stops the widening, and the gap of a leaf is known without a traversal
    some = tree.visits(x[:50], 0.1)
    assert set(zip(*some[:2])) == {(r, n) for r, n, g in zip(row, leaf, gap) if g <= 0.1} and 50 < len(some[0]) < len(row)
    assert np.allclose(tree.gaps(x[row], leaf), gap)
    # beyond the margin visits go on until so much was met
    row, leaf, _ = tree.visits(x[:50], 0.0, least=100)
    assert all(tree.weight[leaf[row == i]].sum() >= 100 > tree.weight[leaf[row == i][:-1]].sum() for i in range(50))


def test_recall_is_calibrated():
    x = neighbours.unit(np.random.default_rng(10).normal(size=(1500, 12)))
    kinds = np.arange(1500) % 2
    tree = neighbours.fit(x)
    closest = neighbours.Closest(x[:400], kinds[:400], 5)
    for start in range(0, 1500, 400):
        closest.offer(x[start : start + 400], kinds[start : start + 400])
    score = x[:400] @ x.T
    score[kinds[:400, None] != kinds] = -1
    score[np.arange(400), np.arange(400)] = -1
    best = np.sort(score, axis=1)[:, ::-1][:, :5]
    assert np.allclose(np.sort(closest.score, axis=1)[:, ::-1], best, atol=1e-6)
    _, near, gap = closest.gaps(tree)
    margins = [neighbours.margin_of(near, gap, -1.0, r) for r in (0.5, 0.9, 1.0)]
    assert margins[0] < margins[1] < margins[2] and neighbours.margin_of(near, gap, 2.0, 0.9) == margins[1] and neighbours.margin_of(near[:0], gap[:0], 0.0, 0.9) == 0
    row, leaf, _ = tree.visits(x, 0.0)
    home = dict(zip(row, leaf))
    true = [(i, j) for i in range(400) for j in np.argsort(-score[i])[:5]]
    for margin, least in zip(margins, (0.5, 0.9, 1.0)):
        row, leaf, _ = tree.visits(x, margin)
        visited = set(zip(row, leaf))
        assert sum((i, home[j]) in visited or (j, home[i]) in visited for i, j in true) >= least * len(true)


def test_many_vectors_of_one_direction(spark):
    # more rescaled copies than places, alike up to rounding, beside a hot vector that a third of the rows share
    rng = np.random.default_rng(11)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    x[:40] = x[0] * np.float32(2.0) ** rng.integers(-3, 4, 40)[:, None]
    x[60:100] = x[60]
    got = {}
    for r in neighbours.neighbours(chunk_vectors(spark, x, ["a"] * 120), k=4, width=8, block=16).orderBy("chunk_id", "position").collect():
        got.setdefault(r.chunk_id, []).append(r.neighbour_id)
    assert got == exact(dict(enumerate(neighbours.unit(x))), ["a"] * 120, 4, -2)


def test_no_rows(spark):
    none = chunk_vectors(spark, np.zeros((0, 8)), [])
    assert neighbours.neighbour_pairs(neighbours.neighbours(none, width=8)).count() == 0


def test_a_block_is_searched_without_double_precision_of_the_whole():
    rng = np.random.default_rng(0)
    n, width, leaves = 40_000, 96, 8
    centres = rng.normal(size=(leaves, width))
    own = rng.integers(0, leaves, n)
    vectors = (centres[own] + rng.normal(size=(n, width)) * 0.5).astype(np.float32)
    home = np.where(np.arange(n) < n // 5, own, -1).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(np.arange(n + 1).astype(np.int32)), pa.array(np.arange(n)))
    asked = pa.ListArray.from_arrays(pa.array(np.arange(n + 1).astype(np.int32)), pa.array(own.astype(np.int32)))
    group = pa.table({"h1": np.arange(n), "h2": np.arange(n), "ids": ids, "home": home, "leaves": asked, "vector": pa.array([v.tobytes() for v in vectors], pa.binary())})
    group = pa.concat_tables([group.slice(0, 7_001), group.slice(7_001)])
    tracemalloc.start()
    got = neighbours._search(group, 3, width, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * vectors.nbytes, peak / vectors.nbytes
    unit = neighbours.unit(vectors)
    found = dict(zip(got["h1"].to_pylist(), got["near"].to_pylist()))
    for row in (0, 7_000, 7_001, n - 1):
        met = np.flatnonzero((home == own[row]) | ((row < n // 5) & (own == own[row])))
        best = sorted((-float(unit[o] @ unit[row]), int(o)) for o in met)[:4]
        assert [x["id"] for x in found[row]] == [o for _, o in best]
