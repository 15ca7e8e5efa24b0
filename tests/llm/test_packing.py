import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from brute import docs

from scoreline.llm import packing, tokens
from scoreline.llm.queries import QUERIES, tokenizer


def _check(rows, ids_of, window):
    """Each id of each document in one piece; gapless sequences; only powers of two are not full."""
    seqs, per_doc = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        per_doc.setdefault(r.doc_id, []).append(r)
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end == window or (end < window and end & (end - 1) == 0)
    assert set(per_doc) == set(ids_of)
    for i, parts in per_doc.items():
        parts.sort(key=lambda r: r.start)
        ids, at = ids_of[i], 0
        for r in parts:
            assert r.start == at and r.doc_tokens == len(ids)
            yield r, ids[at:at + r.length]
            at += r.length
        assert at == len(ids)


def _ids(texts):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    lib.encode_special_tokens = True
    return [[*e.ids, 1] for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = dict(zip([r.doc_id for r in table], _ids([r.text for r in table])))
    for r, part in _check(QUERIES["op2_packing"](spark, sf).collect(), ids, 2048):
        assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())


def test_edges(spark):
    texts = [None, "", "word", "many words " * 3000, "same text here", "same text here", " "]
    df = docs(spark, texts, sequence_id=["x"] * 7, length=["y"] * 7)
    ids = dict(enumerate(_ids(texts)))
    for window in (8, 64):
        for r, part in _check(packing.pack(df, tokenizer("word_bpe_49k.json"), window).collect(), ids, window):
            assert np.frombuffer(r.ids, dtype="<u2").tolist() == part
    assert packing.pack(df.limit(0), tokenizer("word_bpe_49k.json")).count() == 0
    twice = packing.pack(df.where("doc_id = 2").union(df.where("doc_id = 2")), tokenizer("word_bpe_49k.json"))
    assert twice.count() == 2


def test_plan_uses_no_more_than_there_is():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 65, 5000), np.full(3000, 20), np.r_[np.full(900, 32), 64], np.array([5])):
        hist = np.bincount(lengths, minlength=65)
        combos, counts, used = packing.plan(hist, 64)
        assert (combos.sum(axis=1) == 64).all() and (counts > 0).all()
        spent = np.bincount(combos.ravel(), weights=np.repeat(counts, 3), minlength=65)
        spent[0] = 0
        assert (used == spent).all() and (used <= hist).all()
    hist = np.bincount(rng.integers(1, 65, 20000), minlength=65)
    assert (packing.plan(hist, 64)[2] * np.arange(65)).sum() > 0.8 * (hist * np.arange(65)).sum()


def test_digest_is_taken_without_text(spark):
    """crc32 comes from the ids themselves, not from a hexadecimal string of them; null for null."""
    values = [[], [0], [1, 255, 256, 49_407], list(range(2048)), [65_535]]
    rows = [(np.array(v, dtype="<u2").tobytes(),) for v in values] + [(None,)]
    df = spark.createDataFrame(rows, "ids binary").select("ids", packing.ids_crc32("ids").alias("c"))
    assert [r.c for r in df.collect()] == [zlib.crc32(np.array(v, dtype="<u4").tobytes()) for v in values] + [None]
    assert "hex" not in df._jdf.queryExecution().toString().lower()


def test_pieces_leave_slice_by_slice(monkeypatch):
    """A batch's first pieces leave before the rest of its texts is encoded: a worker never holds the ids of a whole batch."""
    held = []

    class Documents:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            held.append(run)

    monkeypatch.setattr(tokens, "SLICE", 200)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 7)))
    path, done = tokenizer("word_bpe_49k.json"), []
    enc = tokens.encoder(path, spaced=False)
    plain = enc._slice
    monkeypatch.setattr(enc, "_slice", lambda texts: done.append(len(texts)) or plain(texts))
    texts = [f"word {i} and more of it" * (i % 4) for i in range(300)]
    packing.pieces(Documents(), path, 8)
    out = held[0](iter([pa.record_batch([pa.array(range(300), pa.int64()), pa.array(texts)], names=["doc_id", "text"])]))
    rows = next(out).to_pylist()
    assert 0 < sum(done) < 300
    rows += [r for batch in out for r in batch.to_pylist()]
    assert sum(done) == 300
    whole = {}
    for r in rows:
        assert r["start"] == len(whole.setdefault(r["doc_id"], [])) and r["chunk"] == 7
        whole[r["doc_id"]] += np.frombuffer(r["ids"], dtype="<u2").tolist()
    assert whole == dict(enumerate(_ids(texts)))
    assert all(sorted(r["nth"] for r in rows if r["length"] == n) == list(range(sum(r["length"] == n for r in rows))) for n in range(1, 9))


def test_more_pieces_than_are_copied_at_once(spark):
    """Batches beyond ``ROWS`` pieces keep every piece, its ids and its digest."""
    texts = [f"w{i % 97} text" * (1 + i % 3) for i in range(2 * packing.ROWS + 11)]
    ids = dict(enumerate(_ids(texts)))
    packed = packing.pack(docs(spark, texts).coalesce(1), tokenizer("word_bpe_49k.json"), 64)
    rows = packed.select("*", packing.ids_crc32("ids").alias("crc")).collect()
    for r, part in _check(rows, ids, 64):
        assert np.frombuffer(r.ids, dtype="<u2").tolist() == part and r.crc == zlib.crc32(np.array(part, dtype="<u4").tobytes())
