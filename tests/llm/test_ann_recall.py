"""Recall of the vector index with production parameters."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from scoreline.llm import ann, queries


def _recall(spark, tmp_path, e, every, **options):
    e = e.astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(len(e)), "embedding": list(e)}), tmp_path / "v.parquet")
    got = {}
    df = spark.read.parquet(str(tmp_path / "v.parquet"))
    for r in ann.search(df, ann.F.col("vec_id") % every == 0, **options).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in range(0, len(e), every):
        s = e.astype(float) @ e[q].astype(float)
        s[q] = -np.inf
        hits.append(len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    return np.mean(hits)


def test_weakly_clustered(spark, tmp_path):
    e = np.random.default_rng(1).normal(size=(100_000, 64))
    assert _recall(spark, tmp_path, e / np.linalg.norm(e, axis=1, keepdims=True), 2000) >= 0.95


def test_mixed_norms(spark, tmp_path):
    rng = np.random.default_rng(2)
    e = rng.normal(size=(100, 64))[rng.integers(0, 100, 20_000)] + 0.5 * rng.normal(size=(20_000, 64))
    e *= np.exp(rng.normal(size=(len(e), 1))) / np.linalg.norm(e, axis=1, keepdims=True)
    assert _recall(spark, tmp_path, e, 400, least_classes=0) >= 0.95


def test_registered_query_uses_lists(spark, monkeypatch):
    """No table is so small that the query falls back to one list."""
    lists = []
    real = ann.balanced_kmeans
    monkeypatch.setattr(ann, "balanced_kmeans", lambda x, k, **o: lists.append(k) or real(x, k, **o))
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op4_nearest"](spark, sf).collect()
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, e = np.array([r.vec_id for r in vectors]), np.array([r.embedding for r in vectors], dtype=float)
    got, hits = {}, []
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for at in np.flatnonzero(ids % 20 == 0):
        s = e @ e[at]
        s[at] = -np.inf
        hits.append(len(got[int(ids[at])] & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    assert lists == [int(2 * len(ids) ** 0.5)] and np.mean(hits) >= 0.9
