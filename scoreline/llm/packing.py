"""Sequence packing by non-negative least squares on the length histogram (after Krell et al., 2021).

1. Every document is encoded once; its ids are cut into pieces of at most ``window``: full windows and one
   remainder. The pieces are written once, each with its number among the pieces of its length in
   its chunk (the task that wrote it), which a retried task reproduces.
2. The histogram over lengths (``window`` rows whatever the corpus) goes to the driver. All pairs and
   triples of lengths that fill a window exactly are the columns of a sparse matrix; repeat counts
   solve non-negative least squares against the histogram, are rounded down and never exceed it.
3. Counts per (chunk, length) give each piece its rank in its length: a window over one row per
   chunk. The rank falls into a combination's slot (a table bounded by the number of
   combinations) or into the residual.
4. The residual is packed greedily, longest first, next-fit with cuts: all residual pieces of a length
   are equal, so a piece's place is arithmetic. Each window boundary cuts at most one piece, and the
   last partial window is split at powers of two, which are not padded. So nothing is padded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .tokens import encoder

ROWS = 2048  # pieces whose ids are copied at once


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int = 1) -> DataFrame:
    """(doc_id, doc_tokens, start, length, ids, chunk, nth): pieces of at most ``window`` ids, uncut otherwise.

    ``ids`` holds little-endian unsigned 16-bit values (32-bit for vocabularies beyond 65,536).
    """
    def run(batches):
        enc = encoder(tokenizer, spaced=False)
        width = enc.dtype.itemsize
        tail = np.array([end_id], dtype=enc.dtype).tobytes()
        count = np.zeros(window + 1, dtype=np.int64)
        chunk = TaskContext.get().partitionId()
        for batch in batches:
            for first, encoded in enc.encoded(batch.column(1)):
                rows, start, total, ids, nth = [], [], [], [], []
                for row, raw in enumerate(encoded.to_pylist(), first):
                    raw += tail
                    n = len(raw) // width
                    for at in range(0, n, window):
                        piece = raw[at * width:(at + window) * width]
                        rows.append(row)
                        start.append(at)
                        total.append(n)
                        ids.append(piece)
                        length = len(piece) // width
                        nth.append(count[length])
                        count[length] += 1
                length = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)) // width
                table = pa.table([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(total, pa.int64()),
                                  pa.array(start, pa.int64()), pa.array(length), pa.array(ids, pa.binary()),
                                  pa.array(np.full(len(ids), chunk, dtype=np.int64)), pa.array(nth, pa.int64())],
                                 names=["doc_id", "doc_tokens", "start", "length", "ids", "chunk", "nth"])
                yield from table.to_batches(max_chunksize=4096)
        pa.default_memory_pool().release_unused()  # the worker waits on with its cache alone
    schema = "doc_id long, doc_tokens long, start long, length int, ids binary, chunk long, nth long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


# -- the plan (driver side; its size depends on the window only) -----------------------------------

def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """Rows (a, b, c) with a + b + c = window, a <= b <= c, of present lengths; unused places are 0."""
    lengths = np.flatnonzero(present)
    lengths = lengths[lengths > 0]
    has = np.zeros(window + 1, dtype=bool)
    has[lengths] = True
    out = [np.array([[0, 0, window]])] if has[window] else []
    a = lengths[2 * lengths <= window]
    a = a[has[window - a]]
    out.append(np.stack([np.zeros_like(a), a, window - a], axis=1))
    for x in lengths[3 * lengths <= window]:
        b = lengths[(lengths >= x) & (x + 2 * lengths <= window)]
        b = b[has[window - x - b]]
        out.append(np.stack([np.full_like(b, x), b, window - x - b], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)


def solve(combos: np.ndarray, hist: np.ndarray, steps: int = 60) -> np.ndarray:
    """Non-negative x with sum over combos of x * (uses of each length) close to ``hist``, by accelerated
    projected gradient on a diagonally scaled system; columns have at most three non-zeros."""
    if not len(combos):
        return np.zeros(0)
    size = len(hist)
    scale = hist.max()
    target = hist / scale
    weight = np.arange(size) / size  # a token left over costs the same whatever its piece's length
    uses = np.bincount(combos.ravel(), minlength=size).astype(float)
    uses[0] = 0
    step = 1 / (3 * np.maximum(1, (uses * weight ** 2)[combos].max(axis=1)))  # bounds the curvature per column
    x = np.zeros(len(combos))
    y, t = x, 1.0
    for _ in range(steps):
        got = np.bincount(combos.ravel(), weights=np.repeat(y, 3), minlength=size)
        miss = (got - target) * weight ** 2
        miss[0] = 0
        new = np.maximum(0, y - step * miss[combos].sum(axis=1))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x * scale


def plan(hist: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(combos, counts, used): whole repeat counts that never use more pieces than there are.

    Rounding is systematic: whole steps of the running sum over combinations in order of their lengths,
    so that many small repeat counts keep their total; then counts are cut to what is left.
    """
    combos = combinations(window, hist > 0)
    run = np.floor(np.cumsum(solve(combos, hist.astype(float))) + 0.5).astype(np.int64)
    counts = np.diff(np.r_[0, run])
    left = hist.tolist()
    taken = {}
    for k in np.flatnonzero(counts):
        parts = [int(x) for x in combos[k] if x]
        n = min(int(counts[k]), *(left[x] // parts.count(x) for x in parts))
        if n:
            taken[int(k)] = n
            for x in parts:
                left[x] -= n
    # What rounding left over and still fits as pairs, longest first.
    pair = {int(c[2]): int(k) for k, c in enumerate(combos) if c[0] == 0}
    for b, k in sorted(pair.items(), reverse=True):
        a = window - b
        n = left[b] if a == 0 else left[b] // 2 if a == b else min(left[a], left[b])
        if n:
            taken[k] = taken.get(k, 0) + n
            left[b] -= n
            if a:
                left[a] -= n
    live = np.array(sorted(taken), dtype=np.int64)
    return combos[live], np.array([taken[int(k)] for k in live], dtype=np.int64), hist.astype(np.int64) - np.array(left)


class Places:
    """Where the piece of a given length and rank goes; built from the plan alone."""

    def __init__(self, hist: np.ndarray, window: int):
        self.window = window
        combos, counts, self.used = plan(hist, window)
        self.used[0] = 0
        base = np.cumsum(counts) - counts  # first sequence of each combination
        self.sequences = int(counts.sum())
        slots: list = [[] for _ in range(window + 1)]
        for k in range(len(combos)):
            offset = 0
            for length in combos[k][::-1]:
                if length:
                    slots[length].append((base[k], offset, counts[k]))
                    offset += length
        self.first, self.seq, self.off = {}, {}, {}
        for length, s in enumerate(slots):
            if s:
                b, o, c = (np.array(v, dtype=np.int64) for v in zip(*s))
                self.first[length], self.seq[length], self.off[length] = np.cumsum(c) - c, b, o
        rest = np.maximum(0, hist.astype(np.int64) - self.used)
        rest[0] = 0
        tokens = rest * np.arange(window + 1)
        self.at = tokens[::-1].cumsum()[::-1] - tokens  # residual stream: longest pieces first
        total = int(tokens.sum())
        self.full = total // window * window
        tail, self.bounds = total - self.full, [self.full]
        while tail:  # powers of two, largest first
            self.bounds.append(self.bounds[-1] + (1 << (tail.bit_length() - 1)))
            tail -= 1 << (tail.bit_length() - 1)
        self.bounds = np.array(self.bounds)

    def place(self, length: int, rank: np.ndarray):
        """Planned pieces: (sequence, offset) arrays; residual ones have sequence -1 and offset = stream place."""
        seq, off = np.full(len(rank), -1, dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
        planned = rank < self.used[length]
        if planned.any():
            k = np.searchsorted(self.first[length], rank[planned], side="right") - 1
            seq[planned] = self.seq[length][k] + rank[planned] - self.first[length][k]
            off[planned] = self.off[length][k]
        off[~planned] = self.at[length] + (rank[~planned] - self.used[length]) * length
        return seq, off

    def cut(self, at: int, length: int):
        """(start in the piece, length, sequence, offset) of a residual piece that lies at ``at``."""
        done = 0
        while done < length:
            p = at + done
            if p < self.full:
                k, start, end = p // self.window, p // self.window * self.window, (p // self.window + 1) * self.window
            else:
                j = int(np.searchsorted(self.bounds, p, side="right")) - 1
                k, start, end = self.full // self.window + j, int(self.bounds[j]), int(self.bounds[j + 1])
            n = min(length - done, end - p)
            yield done, n, self.sequences + k, p - start
            done += n


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into sequences of at most ``window`` ids.

    One row per piece: (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ``ids`` are
    the piece's ids as in :func:`pieces`. Each id of every document, the end id included, lies in
    exactly one piece; a sequence's pieces have gapless offsets from 0. Every sequence but those of
    the last partial window is full; those have power-of-two lengths. Null or empty text: the end id
    alone. A repeated row is packed once per row. Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    table = staged(pieces(docs, tokenizer, window, end_id), "pieces")
    counts = table.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    counts = staged(counts, "lengths")
    hist = np.zeros(window + 1, dtype=np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # <= window rows
        hist[length] = n
    places = spark.sparkContext.broadcast(Places(hist, window))  # bounded by the number of combinations
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk")
                             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "chunk", F.coalesce(before, F.lit(0)).alias("before"))

    def run(batches):
        where = places.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in (3, 5))
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                seq[at], off[at] = where.place(int(n), rank[at])
            ids = batch.column(4)
            row = np.arange(len(length))
            begin, size = np.zeros(len(length), np.int64), length.astype(np.int64)
            left = np.flatnonzero(seq < 0)
            if len(left):
                got = [(r, *c) for r in left for c in where.cut(int(off[r]), int(length[r]))]
                r, b, n, s, o = (np.array(x, dtype=np.int64) for x in zip(*got))
                keep = seq >= 0
                row, begin, size, seq, off = (np.r_[x[keep], y] for x, y in
                                              ((row, r), (begin, b), (size, n), (seq, s), (off, o)))
            start = batch.column(2).to_numpy()
            for at in range(0, len(row), ROWS):
                r, b, n, s, o = (x[at:at + ROWS] for x in (row, begin, size, seq, off))
                take = pa.array(r)
                part = []
                for raw, whole, lo, count in zip(ids.take(take).to_pylist(), length[r].tolist(), b.tolist(), n.tolist()):
                    width = len(raw) // whole
                    part.append(raw[lo * width:(lo + count) * width])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(start[r] + b), pa.array(n), pa.array(part, pa.binary()),
                                                  batch.column(1).take(take), pa.array(s), pa.array(o)],
                                                 names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    ranked = table.join(offsets, ["length", "chunk"]).select(
        "doc_id", "doc_tokens", "start", "length", "ids", (F.col("before") + F.col("nth")).alias("rank"))
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def ids_crc32(ids: str):
    """crc32 of a piece's 16-bit ids as little-endian unsigned 32-bit values; null for null."""
    @F.arrow_udf("long")
    def crc(raw: pa.Array) -> pa.Array:
        return pa.array([None if x is None else zlib.crc32(np.frombuffer(x, dtype="<u2").astype("<u4"))
                         for at in range(0, len(raw), ROWS) for x in raw.slice(at, ROWS).to_pylist()], pa.int64())
    return crc(ids)
