"""Hard negatives against the definition, and packed products against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreline.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, every=4, scale=256, positives=5, negatives=5, low=80, high=100):
    whole = sorted({(i, tuple(int(np.floor(x * scale)) for x in e), lab) for i, e, lab in rows})
    out = []
    for i, e, lab in whole:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(e, f)), j, other) for j, f, other in whole)
        for ps, pj, _ in [x for x in scored if x[2] == lab and x[1] != i][:positives]:
            fit = [x for x in scored if x[2] != lab and low * -ps <= 100 * -x[0] <= high * -ps][:negatives]
            out += [(i, pj, r + 1, j, -ps, -s) for r, (s, j, _) in enumerate(fit)]
    return sorted(out)


def got(df, **options):
    return sorted(map(tuple, hardneg.mine(df, F.col("vec_id") % 4 == 0, **options).collect()))


def random_rows(n, labels, dims=3, seed=5, step=8):
    rng = np.random.default_rng(seed)
    return [(i, (rng.integers(-step, step, dims) / step).tolist(), int(rng.integers(labels))) for i in range(n)]


def test_against_the_definition(spark, monkeypatch):
    rows = random_rows(160, 4)  # coarse vectors: many ties
    rows += [(500 + i, rows[0][1], i % 3) for i in range(120)] + rows[:9]  # a hot vector under three labels, repeats
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    assert want and got(df) == want
    monkeypatch.setattr(hardneg, "PIECE", 7)
    monkeypatch.setattr(hardneg, "AT_ONCE", 3)
    assert got(df, block=3 * 10) == want  # many blocks and groups


def test_one_label_bad_rows_and_empty(spark):
    bad = [(4, None, 1), (8, [1.0, None, 0.0], 1), (12, [float("nan"), 0.0, 0.0], 1), (16, [float("inf"), 0.0, 0.0], 1),
           (20, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    rows = random_rows(40, 2)
    df = spark.createDataFrame([(*r, 0, "c") for r in bad + rows], SCHEMA + ", cid int, q string")  # clashing names
    assert got(df) == plain(rows)
    assert got(df.limit(0)) == []
    assert got(df.withColumn("label", F.lit(3))) == []  # no row of another label
    assert got(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)) == []


def test_signs_and_zero_scores(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.9, 0.0], 2), (3, [0.0, 1.0], 2), (4, [0.0, 0.0], 3), (5, [0.0, 2.0], 3), (6, [0.0, 0.0], 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == plain(rows)  # a negative positive score has no negatives, a score of 0 only such of 0


@pytest.mark.parametrize("size,dims,low,high", [(200, 64, 2, 6), (3, 5, 4, 8), (1 << 20, 8, 1, 1), (1 << 40, 8, 3, 3)])
def test_packed_products(size, dims, low, high):
    rng = np.random.default_rng(2)
    a, c = rng.integers(-size, size, (11, dims)), rng.integers(-size, size, (23, dims))
    packed = hardneg.Fields(c, hardneg.longest(a))
    assert low <= packed.fields <= high  # several candidates a wide integer
    want = [[max(min(sum(int(x) * int(y) for x, y in zip(r, s)), (1 << 63) - 1), -(1 << 63)) for s in c] for r in a]
    assert packed.scores(a).tolist() == want


def test_packed_extremes():
    for c in (np.zeros((4, 3), dtype=np.int64), np.full((5, 3), -256), np.full((5, 3), 256), np.array([[-256, 256, 0]])):
        for a in (np.zeros((2, 3), dtype=np.int64), np.full((2, 3), 256), np.full((2, 3), -256)):
            assert (hardneg.Fields(c, hardneg.longest(a)).scores(a) == a @ c.T).all()
