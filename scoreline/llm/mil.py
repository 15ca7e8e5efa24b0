"""Quality classifier: gated attention over passages (Ilse et al., "Attention-based Deep MIL", 2018).

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded (surface counts, then a
learned tanh layer), gated attention a_k ~ exp(w . (tanh(V e_k) * sigmoid(U e_k))) weighs the passages,
and the label is predicted from the weighted sum. Only document labels are used for learning.

Fitting reads a bounded sample of labelled rows (``max_train`` documents, chosen by a hash of the
id, of ``max_passages`` passages in all), each with its whole text; their features go to the driver, at most
``max_passages`` x ``FEATURES`` floats (71 MB by default). Scores use every passage as well.
Scoring is one map over all rows with the weights (a few KB) in the closure; no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import staged, text_key

PASSAGE = 64
# Byte classes: lower, upper, digit, space, line end, sentence mark, other symbol, beyond ASCII.
CLASSES = 8
_CLASS = np.full(256, 6, dtype=np.uint8)
_CLASS[ord("a"):ord("z") + 1] = 0
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 5
_CLASS[128:] = 7
MIX = np.uint64(0x9E3779B97F4A7C15)
FEATURES = CLASSES * CLASSES + 4


def encode(texts: list[str | None]) -> list[np.ndarray]:
    """One (passages x FEATURES) float32 array per text.

    Features of a passage: shares of byte-class bigrams, mean word length, shares of distinct and of
    directly repeated words, and log size. A text without words is one all-zero passage. All texts
    of the call are encoded in one set of array operations; a text's rows don't depend on the others.
    """
    if not texts:
        return []
    parts = [(t or "").encode() + b"\n" for t in texts]
    raw = np.frombuffer(b"\n" + b"".join(parts), dtype=np.uint8)
    cls = _CLASS[raw]
    blank = (cls == 3) | (cls == 4)
    begins = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    size = np.array([len(p) for p in parts])
    doc_at = np.cumsum(size) - size + 1
    first = np.searchsorted(begins, doc_at)
    words = np.diff(np.r_[first, len(begins)])
    passages = np.maximum(1, -(-words // PASSAGE))
    base = np.cumsum(passages) - passages
    total = int(passages.sum())
    out = np.zeros((total, FEATURES), dtype=np.float32)
    in_doc = np.arange(len(begins)) - np.repeat(first, words)
    of_word = np.repeat(base, words) + in_doc // PASSAGE
    mark = np.zeros(len(raw), dtype=np.int32)
    mark[doc_at] = 1
    mark[begins[(in_doc % PASSAGE == 0) & (in_doc > 0)]] = 1
    of_byte = np.cumsum(mark, dtype=np.int32) - 1
    code = (of_byte[1:] << 6) + ((cls[:-1].astype(np.int32) << 3) | cls[1:])
    grams = np.bincount(code, minlength=total << 6).reshape(total, 64)
    out[:, :64] = grams / grams.sum(axis=1, keepdims=True)
    if len(begins):
        rel = np.arange(len(raw), dtype=np.int32)
        rel[begins[0]:] -= np.repeat(begins, np.diff(np.r_[begins, len(raw)])).astype(np.int32)
        value = (raw.astype(np.uint64) + np.uint64(1)) * (rel.astype(np.uint64) * MIX + np.uint64(1))
        value ^= value >> np.uint64(29)
        value = np.where(blank, np.uint64(0), value * MIX)
        name = np.add.reduceat(value, begins)
        length = np.add.reduceat((~blank).astype(np.int32), begins)
        starts = np.flatnonzero(in_doc % PASSAGE == 0)
        rows, count = of_word[starts], np.diff(np.r_[starts, len(begins)])
        same_next = np.r_[False, (name[1:] == name[:-1]) & (in_doc[1:] > 0)]
        order = np.lexsort((name, of_word))
        n2, w2 = name[order], of_word[order]
        again = np.r_[False, (n2[1:] == n2[:-1]) & (w2[1:] == w2[:-1])]
        out[rows, 64] = np.add.reduceat(length, starts) / count / 10
        out[rows, 65] = 1 - np.add.reduceat(again.astype(np.int32), starts) / count
        out[rows, 66] = np.add.reduceat(same_next.astype(np.int32), starts) / count
        out[rows, 67] = np.log1p(count) / 5
    out[base[words == 0]] = 0
    return np.split(out, base[1:])


def slices(texts: list, chars: int = 1 << 20):
    """Pieces of ``texts`` of about ``chars`` characters (one longer text is a piece of its own)."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t or "") + 1
        if n >= chars:
            yield part
            part, n = [], 0
    if part:
        yield part


@dataclass
class Model:
    """Weights of the network; ``prior`` is the score of every text when there was nothing to learn."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w: dict | None = None

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.w is None or not bags:
            return np.full(len(bags), self.prior)
        x = (np.concatenate(bags) - self.mean) / self.scale
        starts = np.cumsum([0, *(len(b) for b in bags[:-1])])
        return _forward(self.w, np.clip(x, -8, 8), starts)["y"]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(w: dict, x: np.ndarray, starts: np.ndarray) -> dict:
    count = np.diff(np.r_[starts, len(x)])
    e = np.tanh(x @ w["E"] + w["eb"])
    v, u = np.tanh(e @ w["V"]), _sigmoid(e @ w["U"])
    s = (v * u) @ w["a"]
    s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), count))
    att = s / np.repeat(np.add.reduceat(s, starts), count)
    z = np.add.reduceat(att[:, None] * e, starts)
    return {"count": count, "e": e, "v": v, "u": u, "att": att, "z": z, "y": _sigmoid(z @ w["c"] + w["b"])}


def _gradients(w: dict, x: np.ndarray, starts: np.ndarray, y: np.ndarray, decay: float) -> dict:
    f = _forward(w, x, starts)
    d = (f["y"] - y) / len(y)
    dz = np.repeat(d[:, None] * w["c"][None, :], f["count"], axis=0)
    de = f["att"][:, None] * dz
    datt = (dz * f["e"]).sum(axis=1)
    mean = np.repeat(np.add.reduceat(f["att"] * datt, starts), f["count"])
    ds = f["att"] * (datt - mean)
    dv = ds[:, None] * w["a"] * f["u"] * (1 - f["v"] ** 2)
    du = ds[:, None] * w["a"] * f["v"] * f["u"] * (1 - f["u"])
    de += dv @ w["V"].T + du @ w["U"].T
    dh = de * (1 - f["e"] ** 2)
    g = {"E": x.T @ dh, "eb": dh.sum(axis=0), "V": f["e"].T @ dv, "U": f["e"].T @ du,
         "a": (f["v"] * f["u"]).T @ ds, "c": f["z"].T @ d, "b": d.sum()}
    return {k: g[k] + decay * w[k] * (k not in ("b", "eb")) for k in g}


def fit_bags(bags: list[np.ndarray], labels: np.ndarray, steps: int = 300, hidden: int = 24, gate: int = 12,
             seed: int = 7, rate: float = 0.02, decay: float = 1e-4, batch: int = 512) -> Model:
    """Fit by Adam on bags and 0/1 labels. No rows: prior 0.5; one class only: its share as prior."""
    labels = np.asarray(labels, dtype=np.float64)
    if not len(bags) or labels.min() == labels.max():
        return Model(float(labels.mean()) if len(bags) else 0.5)
    x = np.concatenate(bags)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.02
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    w = {"E": rng.normal(0, d ** -0.5, (d, hidden)), "eb": np.zeros(hidden),
         "V": rng.normal(0, hidden ** -0.5, (hidden, gate)), "U": rng.normal(0, hidden ** -0.5, (hidden, gate)),
         "a": rng.normal(0, gate ** -0.5, gate), "c": rng.normal(0, hidden ** -0.5, hidden),
         "b": np.float64(np.log(labels.mean() / (1 - labels.mean())))}
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    scaled = [np.clip((b - mean) / scale, -8, 8) for b in bags]
    for step in range(1, steps + 1):
        pick = rng.choice(len(bags), size=min(batch, len(bags)), replace=False)
        part = [scaled[i] for i in pick]
        starts = np.cumsum([0, *(len(b) for b in part[:-1])])
        g = _gradients(w, np.concatenate(part), starts, labels[pick], decay)
        now = rate * (1 - step / (steps + 1))
        for k in w:
            m1[k] = 0.9 * m1[k] + 0.1 * g[k]
            m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
            w[k] = w[k] - now * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(float(labels.mean()), mean, scale, w)


def held_out(doc_id: str = "doc_id"):
    """True for documents that must not be learned from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitting(sizes: list[int], most: int) -> list[int]:
    """Positions of the bags, in order, that fit into ``most`` passages; one too large for what is left is left out whole."""
    out = []
    for i, n in enumerate(sizes):
        if n <= most:
            out.append(i)
            most -= n
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = 8000,
        max_passages: int = 1 << 18, **options) -> Model:
    """Fit on at most ``max_train`` labelled documents that are not held out, with all their passages.

    Labels other than 0 and 1, and null ids, are ignored; a doc_id labelled twice counts with its
    smaller label, a doc_id with several texts with that of the smallest hash. The documents are taken in the order
    of a hash of their ids; one that would bring the passages of the sample above ``max_passages`` is left
    out as a whole, none is shortened.
    """
    chosen = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
              .groupBy("doc_id").agg(F.min(label).alias("__y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bags = [b for texts in slices(part.column(0).to_pylist()) for b in encode(texts)]
                yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bags], pa.binary()), pa.array([len(b) for b in bags], pa.int64()),
                                                  *part.columns[1:]], names=["bag", "n", "y", "id", "th"])
    # The sample is bounded by max_train rows of 16 bytes, so it may be broadcast.
    rows = staged(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "__y", "doc_id", text_key())
                  .mapInArrow(run, "bag binary, n long, y int, id long, th long")
                  .groupBy("id").agg(F.min(F.struct("th", "y", "n", "bag")).alias("r")).select("id", "r.y", "r.n", "r.bag"), "bags")
    sizes = rows.select("id", "n").orderBy(F.xxhash64("id"), "id").collect()
    ids = {sizes[i].id for i in fitting([r.n for r in sizes], max_passages)}
    if len(ids) < len(sizes):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in sorted(ids)], "id long")), "id")
    rows = sorted(rows.collect(), key=lambda r: r.id)
    bags = [np.frombuffer(r.bag, dtype=np.float32).reshape(-1, FEATURES) for r in rows]
    return fit_bags(bags, np.array([r.y for r in rows]), **options)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``name``: the probability of label 1, from the whole ``text`` alone.

    Null and empty texts are scored as one empty passage. Any columns may come along; one already
    called ``name`` is replaced. Repeated rows stay, with equal scores.
    """
    docs = docs.drop(name)
    names = [*docs.columns, name]
    at = names.index("text")

    def run(batches):
        for batch in batches:
            out = np.concatenate([np.empty(0), *(model.scores(encode(p)) for p in slices(batch.column(at).to_pylist()))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=names)
    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, DoubleType()))
