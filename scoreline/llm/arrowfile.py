"""Token ids as Arrow files of fixed-size-list batches.

Documents are range-partitioned by doc_id (one shuffle), and every task writes one shard: an Arrow file
whose batches hold ``tokens`` and ``mask`` as fixed-size lists of ``window`` values, so that sequence i
of a mapped file is a slice without a copy, and a second file with each document's id, first token and
number of tokens. The mask marks a shard's padding (the end of its last sequence). Tasks write
under names of their own attempt and report them; only the reported files of committed tasks form
the data set, so a retried or doubled task leaves no trace in it.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import staged, text_key
from .tokens import encoder

BATCH = 512  # sequences per record batch
BLOCK = 1024  # shards whose sizes are summed by one task


def _open(uri: str):
    """(file system, path) of a folder; a plain path is local."""
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[len("file:"):])
    return pafs.LocalFileSystem(), uri


class ShardWriter:
    """Writes the tokens of successive documents as equal-length sequences."""

    def __init__(self, fs, path: str, window: int, dtype: np.dtype):
        self.window, self.dtype = window, dtype
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("tokens", pa.list_(kind, window)), ("mask", pa.list_(pa.bool_(), window))])
        self.sink = fs.open_output_stream(path)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[bytes] = []
        self.bytes = 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.bytes += len(ids)
        if self.bytes >= BATCH * self.window * self.dtype.itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data = np.frombuffer(b"".join(self.held), dtype=self.dtype)
        whole = len(data) if last else len(data) // self.window * self.window
        rest, data = data[whole:], data[:whole]
        for at in range(0, len(data), BATCH * self.window):
            part = data[at:at + BATCH * self.window]
            pad = -len(part) % self.window
            mask = np.r_[np.ones(len(part), bool), np.zeros(pad, bool)]
            part = np.r_[part, np.zeros(pad, self.dtype)]
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(part), self.window),
                      pa.FixedSizeListArray.from_arrays(pa.array(mask), self.window)]
            self.out.write_batch(pa.record_batch(arrays, schema=self.schema))
        self.held, self.bytes = [rest.tobytes()], rest.nbytes

    def close(self) -> None:
        self._flush(True)
        self.out.close()
        self.sink.close()


def write(docs: DataFrame, tokenizer: str, folder: str, window: int = 2048, end_id: int = 2) -> DataFrame:
    """Write all ``docs`` (doc_id, text) in ascending doc_id order; returns the manifest, staged.

    Manifest: (shard, n_docs, n_tokens, path, index_path), shards in order. Null ids come first; rows of
    the same doc_id are ordered by text hash and text. Null or empty text: the end id alone.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("__th").asc(), F.col("text").asc_nulls_first()]
    rows = docs.select("doc_id", "text", text_key().alias("__th"))
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)

    def run(batches):
        ctx = TaskContext.get()
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        name = f"{base}/{ctx.partitionId():06d}-{uuid.uuid4().hex}"
        enc = encoder(tokenizer, spaced=True)
        tail = np.array([end_id], dtype=enc.dtype).tobytes()
        shard, index, place, n_docs = None, None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if shard is None:
                shard = ShardWriter(fs, f"{name}.arrow", window, enc.dtype)
                sink = fs.open_output_stream(f"{name}.index.arrow")
                schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
                index = pa.ipc.new_file(sink, schema)
            size = []
            for ids in enc.encode(batch.column(1)).to_pylist():
                shard.add(ids + tail)
                size.append(len(ids) // enc.dtype.itemsize + 1)
            end = place + np.cumsum(size)
            index.write_batch(pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(end - size), pa.array(size, pa.int64())],
                                              schema=schema))
            place, n_docs = int(end[-1]), n_docs + len(size)
        if shard is not None:
            shard.close()
            index.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"shard": ctx.partitionId(), "n_docs": n_docs, "n_tokens": place,
                                               "path": f"{name}.arrow", "index_path": f"{name}.index.arrow"}])
    return staged(rows.mapInArrow(run, "shard long, n_docs long, n_tokens long, path string, index_path string"), "manifest")


def read(manifest: DataFrame, folder: str, window: int = 2048) -> DataFrame:
    """One row per document, from the files: (doc_id, start, n_tokens, ids_crc32).

    ``start``: tokens of all documents before it. Local files are mapped, others read as streams.
    """
    # Running sum over shards in two steps of bounded windows.
    m = manifest.withColumn("block", F.floor(F.col("shard") / BLOCK))
    inner = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = m.groupBy("block").agg(F.sum("n_tokens").alias("n")).select(
        "block", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("b0"))
    m = m.withColumn("s0", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(blocks, "block")
    m = m.select("path", "index_path", (F.col("b0") + F.col("s0")).alias("first"))

    def run(batches):
        fs, _ = _open(folder)
        local = isinstance(fs, pafs.LocalFileSystem)
        opened = (lambda p: pa.memory_map(p)) if local else fs.open_input_file
        for batch in batches:
            for path, index_path, first in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with opened(path) as f, opened(index_path) as g:
                    seqs, index = Shard(f, window), pa.ipc.open_file(g)
                    for i in range(index.num_record_batches):
                        docs = index.get_batch(i)
                        start, size = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                        crc = [seqs.crc(s, n) for s, n in zip(start.tolist(), size.tolist())]
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(start + first), docs.column(2),
                                                          pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
    # One task per shard: files are read where the manifest's row goes.
    spread = m.repartition(max(1, min(m.count(), 1 << 16)), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


class Shard:
    """Random access to the sequences and token ranges of one opened Arrow file."""

    def __init__(self, file, window: int):
        self.file = pa.ipc.open_file(file)
        self.window = window
        lens = [self.file.get_batch(i).num_rows for i in range(self.file.num_record_batches)]
        self.first = np.cumsum([0, *lens])  # first sequence of each batch
        self.at, self.held = -1, None

    def _batch(self, k: int):
        if k != self.at:
            self.at, self.held = k, self.file.get_batch(k)
        return self.held

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, mask) of sequence i; the tokens are a view of the file's own buffer."""
        k = int(np.searchsorted(self.first, i, side="right")) - 1
        lo = (i - int(self.first[k])) * self.window
        tokens, mask = (self._batch(k).column(c).flatten().slice(lo, self.window) for c in (0, 1))
        return tokens.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def crc(self, start: int, size: int) -> int:
        """crc32 of tokens start .. start + size as little-endian unsigned 32-bit values."""
        crc, done = 0, 0
        while done < size:
            k = int(np.searchsorted(self.first, (start + done) // self.window, side="right")) - 1
            batch = self._batch(k)
            lo = start + done - int(self.first[k]) * self.window
            n = min(size - done, batch.num_rows * self.window - lo)
            if batch.column(1).flatten().slice(lo, n).true_count != n:
                raise ValueError("a document reaches into padding")
            ids = batch.column(0).flatten().slice(lo, n).to_numpy()
            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
            done += n
        return crc


def new_folder(spark: SparkSession) -> str:
    """A folder of its own under the shared one."""
    return os.path.join(checkpoint_dir(spark), f"arrow-{uuid.uuid4().hex}")
