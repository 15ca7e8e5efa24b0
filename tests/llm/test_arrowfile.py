import zlib

import numpy as np
import pyarrow as pa
from brute import docs

from scoreline.llm import arrowfile
from scoreline.llm.queries import QUERIES, tokenizer

BYTES = "byte_bpe_50k.json"


def _ids(texts):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tokenizer(BYTES))
    lib.encode_special_tokens = True
    return [[*e.ids, 2] for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def _want(rows):
    out, start = [], 0
    for i, ids in rows:
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_query_round_trip(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = _want(zip([r.doc_id for r in table], _ids([r.text for r in table])))
    got = sorted(tuple(r) for r in QUERIES["op8_arrow_files"](spark, sf).collect())
    assert got == want


def test_files_sequences_and_edges(spark, monkeypatch):
    monkeypatch.setattr(arrowfile, "BLOCK", 2)
    texts = ["b text", None, "", "long one " * 900, "b text"]
    df = docs(spark, texts, start=["x"] * 5).selectExpr("if(doc_id = 2, null, doc_id) AS doc_id", "text", "start")
    df = df.union(df.where("doc_id = 0"))
    folder = arrowfile.new_folder(spark)
    manifest = arrowfile.write(df, tokenizer(BYTES), folder, 16)
    order = [2, 0, 0, 1, 3, 4]  # null first, then ascending
    ids = _ids(texts)
    want = _want([(None if i == 2 else i, ids[i]) for i in order])
    got = [tuple(r) for r in arrowfile.read(manifest, folder, 16).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    stream = []
    fs, _ = arrowfile._open(folder)
    for r in manifest.orderBy("shard").collect():
        with fs.open_input_file(arrowfile._open(r.path)[1] if "://" in r.path else r.path) as f:
            assert pa.types.is_fixed_size_list(pa.ipc.open_file(f).schema.field("tokens").type)
            shard = arrowfile.Shard(f, 16)
            for i in range(int(shard.first[-1])):
                tokens, mask = shard.sequence(i)
                assert len(tokens) == len(mask) == 16
                stream += tokens[mask].tolist()
    assert stream == [x for i in order for x in ids[i]]
    empty = arrowfile.write(df.limit(0), tokenizer(BYTES), folder, 16)
    assert arrowfile.read(empty, folder, 16).count() == 0
