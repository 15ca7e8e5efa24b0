"""The pipeline against its stages' plain forms, on the smallest documents."""

import corpus_pipeline
from brute import classes, edits, fingerprint

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_registered():
    assert "pipeline" in entry.queries() and len([q for q in entry.queries() if q.startswith("op")]) == 13
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "mixing sources", "packing"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        if k < 4:
            assert docs.columns == columns
        if name == "quality classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            kept = {r.doc_id for r in after}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept for i in good) >= 0.95 * len(good)
            assert all(r == before[r.doc_id] for r in after)
        if name == "line dedup":
            lines = [(i, x) for i in sorted(before) for x in (before[i].text or "").split("\n") if len(x) >= 20]
            group = classes(len(lines), lambda i, j: lines[i][1] == lines[j][1] or (
                abs(len(lines[i][1]) - len(lines[j][1])) <= 2 and lines[i][1][:1] == lines[j][1][:1]
                and edits(lines[i][1], lines[j][1]) <= 2) if len(lines[i][1]) < 120 or lines[i][1] == lines[j][1] else False)
            left = {}
            for (i, x), g, k2 in zip(lines, group, range(len(lines))):
                if g == k2:
                    left.setdefault(i, []).append(x)
            for r in after:
                got = [x for x in r.text.split("\n") if len(x) >= 20]
                assert set(got) <= set(left.get(r.doc_id, []))
        if name == "simhash near-dedup":
            ids = sorted(before)
            fps = [fingerprint(before[i].text) for i in ids]
            want = classes(len(ids), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
            assert sorted(r.doc_id for r in after) == sorted({ids[w] for w in want})
        if name == "mixing sources":
            assert after and all(r == before[r.doc_id] for r in after)
        if name == "packing":
            assert {r.doc_id for r in after} == set(before)
            assert sum(r.length for r in after if True) > 0
