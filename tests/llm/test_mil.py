import zlib

import numpy as np
import pytest
from brute import docs

from scoreline.llm import mil
from scoreline.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"


def test_gradients():
    rng = np.random.default_rng(0)
    w = {"E": rng.normal(0, .3, (5, 4)), "eb": rng.normal(0, .1, 4), "V": rng.normal(0, .5, (4, 3)),
         "U": rng.normal(0, .5, (4, 3)), "a": rng.normal(0, 1, 3), "c": rng.normal(0, 1, 4), "b": np.float64(.2)}
    x, starts, y = rng.normal(0, 1, (9, 5)), np.array([0, 2, 5, 6]), np.array([1, 0, 1, 0.])

    def loss(w):
        p = mil._forward(w, x, starts)["y"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    g = mil._gradients(w, x, starts, y, 0)
    for k in w:
        around = []
        for step in (1e-5, -1e-5):
            moved = {q: np.array(v, dtype=float) for q, v in w.items()}
            moved[k].flat[0] += step
            around.append(loss(moved))
        assert (around[0] - around[1]) / 2e-5 == pytest.approx(np.ravel(g[k])[0], abs=1e-7)


def test_encoding_is_per_text():
    texts = ["A few words here.", None, "", "x " * 500, " \n ", "Ünïcode ### !!", "a"]
    together = mil.encode(texts)
    assert [len(b) for b in together] == [1, 1, 1, 8, 1, 1, 1]
    for t, b in zip(texts, together):
        assert np.array_equal(mil.encode([t])[0], b)
    assert not together[1].any() and not together[4].any()


def test_held_out_quality(spark):
    got = {r.doc_id: r for r in QUERIES["op7_quality_classifier"](spark, SF01).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    assert len(got) == 1000
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7)
    y, s = zip(*[(labels[i], r.score) for i, r in got.items() if r.held_out and i in labels])
    y, s = np.array(y), np.array(s)
    wins = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    assert wins > 0.97 and (s[y == 1] >= 0.7).mean() > 0.97


def test_held_out_labels_do_not_matter(spark):
    df = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    flipped = labels.withColumn("quality", mil.F.when(mil.held_out(), 1 - mil.F.col("quality")).otherwise(mil.F.col("quality")))
    a, b = (mil.fit(df, x, steps=3) for x in (labels, flipped))
    assert all(np.array_equal(a.w[k], b.w[k]) for k in a.w)


def test_edges(spark):
    df = docs(spark, ["some text", None, "", "long " * 20000], score=["s"] * 4)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = mil.fit(df, none)
    assert [r.score for r in mil.score(df, model).collect()] == [0.5] * 4
    one = spark.createDataFrame([(0, 1), (1, 1), (3, None), (None, 0)], "doc_id long, quality int")
    assert mil.fit(df, one).prior == 1.0
    assert mil.score(df.limit(0), model).count() == 0
    assert mil.score(df, model).columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]


def test_fitting_is_bounded_and_whole(spark):
    """Repeated ids and long texts: one bag an id, each with all its passages, as many documents as fit."""
    df = docs(spark, ["a b c. " * 3000, "### " * 3000, "plain words here", "x " * 640])
    df = df.union(df).union(df.withColumn("text", mil.F.lit("other")).where("doc_id = 2"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    labels = labels.where(~mil.held_out())
    ids = sorted(r.doc_id for r in labels.collect())
    whole = {0: 141, 1: 47, 2: 1, 3: 10}

    def bags_of(**options):
        seen = []
        real, mil.fit_bags = mil.fit_bags, lambda bags, y, **o: seen.extend(len(b) for b in bags)
        try:
            mil.fit(df, labels, **options)
        finally:
            mil.fit_bags = real
        return seen
    assert len(ids) >= 3 and bags_of() == [whole[i] for i in ids]
    for most in (1, 12, 60, 150):
        seen = bags_of(max_passages=most)
        assert sum(seen) <= most and set(seen) <= set(whole.values())  # never a part of a text
    assert bags_of(max_passages=0) == [] and len(bags_of(max_train=1)) == 1
    assert mil.fitting([5, 9, 3, 0, 2], 9) == [0, 2, 3] and mil.fitting([], 5) == []


def _plain_features(text):
    """The features by plain loops over bytes and words."""
    raw = b"\n" + (text or "").encode() + b"\n"
    words, at = [], None
    for i in range(1, len(raw)):
        if raw[i] in b"\t\n\x0b\x0c\r ":
            if at is not None:
                words.append((at, raw[at:i]))
            at = None
        elif at is None:
            at = i
    bags = max(1, -(-len(words) // mil.PASSAGE))
    out = [[0.0] * mil.FEATURES for _ in range(bags)]
    if not words:
        return out
    starts = [1] + [words[k * mil.PASSAGE][0] for k in range(1, bags)] + [len(raw)]
    for k, row in enumerate(out):
        for i in range(starts[k], starts[k + 1]):
            row[int(mil._CLASS[raw[i - 1]]) * 8 + int(mil._CLASS[raw[i]])] += 1 / (starts[k + 1] - starts[k])
        mine = words[k * mil.PASSAGE:(k + 1) * mil.PASSAGE]
        row[64] = sum(len(w) for _, w in mine) / len(mine) / 10
        row[65] = len({w for _, w in mine}) / len(mine)
        row[66] = sum(words[j][1] == words[j - 1][1] for j in range(k * mil.PASSAGE, k * mil.PASSAGE + len(mine)) if j) / len(mine)
        row[67] = np.log1p(len(mine)) / 5
    return out


def _plain_score(model, bag):
    """The network's score of one bag by plain loops."""
    w, tanh, sig = model.w, np.tanh, lambda t: 1 / (1 + np.exp(-t))
    hidden, weights = [], []
    for row in bag:
        x = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(row, model.mean, model.scale)]
        e = [tanh(sum(x[i] * w["E"][i][h] for i in range(len(x))) + w["eb"][h]) for h in range(len(w["eb"]))]
        gate = [tanh(sum(e[h] * w["V"][h][j] for h in range(len(e)))) * sig(sum(e[h] * w["U"][h][j] for h in range(len(e)))) for j in range(len(w["a"]))]
        hidden.append(e)
        weights.append(np.exp(sum(g * a for g, a in zip(gate, w["a"]))))
    z = [sum(a * e[h] for a, e in zip(weights, hidden)) / sum(weights) for h in range(len(w["eb"]))]
    return sig(sum(a * b for a, b in zip(z, w["c"])) + w["b"])


def test_features_and_scores_against_plain_loops(spark):
    texts = ["A few words here, and here.", None, "", "x " * 500, " \n ", "Ünïcode ### !! 12\tab\n\nend", "a", "one two two three " * 40, "word" * 300,
             "Long text. " * 1500, "中文 字 " * 70]
    for t, bag in zip(texts, mil.encode(texts)):
        assert np.allclose(bag, _plain_features(t), atol=2e-6)
    df = docs(spark, texts, score=["s"] * len(texts))
    df = df.union(df)  # repeated rows beside a clashing score column
    rng = np.random.default_rng(4)
    model = mil.fit_bags([rng.normal(0.3, 0.2, (int(n), mil.FEATURES)).astype(np.float32) for n in rng.integers(1, 5, 40)], np.arange(40) % 2, steps=5)
    rows = mil.score(df, model).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        assert r.score == pytest.approx(_plain_score(model, _plain_features(texts[r.doc_id])), abs=1e-4)
