import random

import numpy as np
from brute import classes, docs, fingerprint

from scoreline.llm import graph, simhash


def test_fingerprint_equals_definition():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "one", "One TWO", "ÀB é x", "a b c", " ".join(rng.choice("abcdefg") for _ in range(400))]
    for t in texts:
        assert simhash.fingerprint(t) == fingerprint(t)


def test_thresholds_cover_every_pair():
    rng = np.random.default_rng(0)
    costs = [np.c_[np.zeros(50), rng.random((50, 4))].cumsum(axis=1) for _ in range(4)]
    t = simhash.allocate(costs, 3)
    assert (t.sum(axis=1) == 0).all() and t.min() >= -1 and t.max() <= 3


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    fps = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for k in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << k
            fps.add(x)
    fps |= {0b111 << k for k in range(20)}  # partitions with one very common value
    fps = sorted(fps)
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    want = classes(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    for block in (4096, 4):  # bounded blocks change nothing
        found = graph.components(simhash.links(frame, block=block)).collect()
        at = {f: i for i, f in enumerate(fps)}
        group = {i: i for i in range(len(fps))}
        for node, root in found:
            group[at[node % 2**64]] = root
        sets, true = {}, {}
        for i in group:
            sets.setdefault(("r", group[i]) if any(at[n % 2**64] == i for n, _ in found) else i, set()).add(i)
            true.setdefault(want[i], set()).add(i)
        assert sorted(map(sorted, sets.values())) == sorted(map(sorted, true.values()))


def _texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    long = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(12)]
    near = [t.replace(t.split()[7], "changed", 1) for t in long[:6]]
    return [*long, *near, *long[:3], None, "", "  ", "x", "X", "x", " ".join(words * 40)]


def test_operator_and_edge_rows(spark):
    texts = _texts()
    df = docs(spark, texts, root=["r"] * len(texts), component_id=["c"] * len(texts))
    df = df.union(df.limit(1))  # a repeated row
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = [fingerprint(t) for t in texts]
    want = classes(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].fp % 2**64 for i in range(len(texts))] == fps
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_null_ids_and_empty(spark):
    df = docs(spark, ["a b c d", "a b c d", "other words here now"])
    df = df.selectExpr("if(doc_id = 0, null, doc_id) AS doc_id", "text", "lang", "source", "n_chars")
    got = simhash.near_duplicates(df).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, 1), (1, 1), (2, 2)}
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [1, 2]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(1000, 1000), (None, 3), (500, 400)], "a long, b long")
    got = dict(graph.components(edges).collect())
    assert got == {**dict.fromkeys(range(41), 0), 400: 400, 500: 400}
