"""Exact top k: ball trees against every pair."""

import numpy as np
import pytest

from scoreline.llm import balltree, vectors

SCHEMA = "vec_id long, embedding array<float>"
EVERY = "vec_id % 5 = 0"


def plain(rows, k, scale=1024, every=5):
    """The definition, in Python's integers."""
    whole = sorted({(i, tuple(int(np.floor(float(np.float32(x)) * scale)) for x in e)) for i, e in rows})
    out = []
    for i, e in whole:
        if i % every:
            continue
        best = sorted((-max(min(sum(a * b for a, b in zip(e, f)), (1 << 63) - 1), -(1 << 63)), j) for j, f in whole if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def got(df, **options):
    options = {"k": 4, "is_query": EVERY} | options
    return sorted(map(tuple, balltree.search(df, **options).collect()))


def clustered(n, clusters, dims, spread, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    return [(i, (centres[rng.integers(clusters)] + spread * rng.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]


def test_against_every_pair_over_many_shards(spark):
    rows = clustered(400, 6, 5, 0.05)
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + rows[:7]  # a vector that many rows share, repeated rows
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows, 4)
    assert got(df) == want
    assert got(df, shard=5 * 16, sample=200, leaf=4, ask=3, rounds=(1, 3)) == want
    assert got(df, shard=5 * 16, sample=16, leaf=4, rounds=()) == want  # cells far from even, one round


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(60)] + [(100, [1.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows, 4)
    for options in ({}, {"shard": 2 * 4, "leaf": 2}):
        assert got(df, **options) == want


def test_bad_few_zero_and_empty_rows(spark):
    bad = [(5, None), (10, [1.0, None]), (15, [float("nan"), 0.0]), (20, [float("inf"), 0.0]), (None, [1.0, 1.0])]
    few = [(0, [0.0, 0.0]), (25, []), (3, [-1.0, 2.0]), (30, [0.5]), (35, [1e30, -1e30]), (40, [-1e30, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in bad + few], SCHEMA + ", cid string, score int")  # clashing names
    padded = [(i, (e + [0.0, 0.0])[:2]) for i, e in few]
    top = (1 << 63) - 1
    whole = {i: [max(min(int(np.floor(float(np.float32(x)) * 1024)), top), -top - 1) for x in e] for i, e in padded}
    want = []
    for i in sorted(whole):
        if i % 5 == 0:
            s = sorted((-max(min(sum(a * b for a, b in zip(whole[i], whole[j])), top), -top - 1), j) for j in whole if j != i)[:4]
            want += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    assert got(df) == want
    assert got(df.limit(0)) == []
    assert got(df, is_query="vec_id > 1000000") == []


def test_one_id_with_several_vectors(spark):
    df = spark.createDataFrame([(5, [1.0]), (5, [2.0]), (7, [3.0]), (7, [1.0])], SCHEMA)
    # Each vector of id 5 is a query; neither is a candidate of the other.
    assert got(df) == sorted([(5, 1, 7, 3 * 1024 ** 2), (5, 2, 7, 1024 ** 2), (5, 1, 7, 6 * 1024 ** 2), (5, 2, 7, 2 * 1024 ** 2)])


def test_bounds_hold_and_prune(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(-500, 500, (300, 6))
    tree = balltree.BallTree(x, 8)
    q = rng.integers(-500, 500, (40, 6)).astype(float)
    length = np.sqrt((q ** 2).sum(axis=1))
    assert sorted(np.concatenate(tree.leaves)) == list(range(300)) and max(map(len, tree.leaves)) <= 8
    for centre, radius in tree.levels:
        b = balltree.bounds(q, length, centre, radius)
        step = len(tree.leaves) // len(centre)
        for i in range(len(centre)):
            held = np.concatenate(tree.leaves[i * step:(i + 1) * step])
            assert (b[:, i] >= (q @ x[held].T).max(axis=1, initial=-np.inf)).all()
    # Well separated clusters: few pairs are scored, the answer is the same.
    rows = clustered(3000, 24, 16, 0.02)
    pairs = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(rows, SCHEMA)
    found = got(df, counted=pairs, shard=16 * 512, leaf=32)
    assert found == plain(rows, 4) and pairs.value < 0.25 * 600 * 3000


@pytest.mark.parametrize("size", [3, 1 << 27, 1 << 50])
def test_products_are_exact(size):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-size, size, (5, 9)), rng.integers(-size, size, (7, 9))
    want = [[max(min(sum(int(x) * int(y) for x, y in zip(r, s)), (1 << 63) - 1), -(1 << 63)) for s in b] for r in a]
    assert vectors.products(a, b).tolist() == want
