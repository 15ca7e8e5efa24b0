import numpy as np

from scoreline.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def _brute(rows, k):
    ids = np.array([i for i, _ in rows])
    e = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    out = {}
    for i in sorted(set(ids[ids % 20 == 0])):
        s = e @ e[np.flatnonzero(ids == i)[0]]
        best = sorted((-x, j) for x, j in zip(s, ids) if j != i)[:k]
        out[int(i)] = [(int(j), -x) for x, j in best]
    return out


def _run(df, **options):
    out = {}
    for r in ann.search(df, ann.F.col("vec_id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_of_the_index(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = _brute([(r.vec_id, r.embedding) for r in df.collect()], 20)
    got = _run(df, least_classes=0)
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]
    assert set(got) == set(want) and np.mean(hits) >= 0.9
    for q in want:
        assert len(got[q]) == 20
        score = dict(want[q])
        assert all(abs(s - score[v]) < 1e-9 for v, s in got[q] if v in score)


def test_exact_list_ties_copies_and_bad_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(200)]  # one vector holds most rows, queries among them
    bad = [(1000, None), (1020, [0.0] * 4), (1040, [1.0, None, 0.0, 0.0]), (1060, [1.0, float("nan"), 0.0, 0.0]),
           (1080, [float("inf"), 0.0, 0.0, 0.0]), (1100, []), (1120, [1.0, 2.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows + bad + rows[:5]], SCHEMA)
    want = _brute(rows, 20)
    for options in ({}, {"block": 8}):
        got = _run(df, **options)
        assert set(got) == set(want)
        for q in want:
            assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
    assert _run(df.limit(0)) == {}
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (7, [0.0, 1.0], 1)], SCHEMA)
    assert _run(few) == {0: [(20, 1.0), (7, 0.0)], 20: [(0, 1.0), (7, 0.0)]}


def test_ties_go_to_the_smaller_id(spark):
    """Equal scores of different vectors, at one list and with production parameters."""
    rows = [(i, [1.0, float(i)]) for i in range(1, 400)] + [(0, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    for options in ({}, {"least_classes": 1000}, {"block": 64}):
        got = [r.vec_id for r in ann.search(df, "vec_id = 0", **options).orderBy("rank").collect()]
        assert got == list(range(1, 21)), options
    rng = np.random.default_rng(6)
    many = [(0, [1.0] + [0.0] * 7)] + [(i, [1.0, *rng.normal(size=7).tolist()]) for i in rng.permutation(np.arange(1, 3000)).tolist()]
    df = spark.createDataFrame([(*r, 1) for r in many], SCHEMA)
    got = [r.vec_id for r in ann.search(df, "vec_id = 0", least_classes=10 ** 6).orderBy("rank").collect()]
    assert got == list(range(1, 21))


def test_rounding_of_a_product_decides_nothing(spark):
    """Scores that differ in the last bits only are ranked by the exact sum, as brute force ranks them."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=16)
    rows = [(0, base.astype(np.float32).tolist())]
    for i in range(1, 300):
        rows.append((i, (base[rng.permutation(16)] if i % 2 else base + 1e-7 * rng.normal(size=16)).astype(np.float32).tolist()))
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = _run(df, least_classes=10 ** 6)
    want = _brute(rows, 20)
    for q in want:
        assert [round(s, 12) for _, s in got[q]] == [round(s, 12) for _, s in want[q]]


def test_lists_save_scoring(spark):
    """On clustered vectors a small part of all pairs is scored, and nearly all neighbours are found."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 24))
    rows = [(i, (centres[rng.integers(60)] + 0.15 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(6000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    pairs = spark.sparkContext.accumulator(0)
    got, want = _run(df, counted=pairs), _brute(rows, 20)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.95
    assert pairs.value < 0.25 * len(want) * len(rows)
