"""SimHash near-duplicates with generalised pigeonhole search (Qin et al., "GPH", 2018).

Fingerprints: 64 majority bits over the XXH64 values of a text's word shingles, in one pass of
Arrow batches. Equal fingerprints collapse by a map-side aggregation first, so a huge group of
copies is one search row.

Search among distinct fingerprints, exact for any distance:

1. The 64x64 co-occurrence of bits over all distinct fingerprints groups correlated bits into
   ``parts`` partitions of equal width (bounded table: 64x64).
2. A histogram of each partition's values (at most ``parts`` x 2^width rows whatever the corpus)
   gives the number of fingerprints within any distance of any value.
3. Generalised pigeonhole: a pair within ``distance`` agrees within t_i on some partition i
   whenever sum(t_i) = distance - parts + 1 (t_i >= -1; -1 skips the partition). Each fingerprint
   gets its own thresholds by dynamic programming over the partitions on those counts, so a value
   shared by a large part of the corpus is skipped and paid for elsewhere.
4. Rows meet on (partition, value, block); a value with many rows is dealt to many blocks, from
   the histogram. A task verifies the distance on the whole fingerprints and emits a spanning
   forest of the verified links of its keys, never the pairs: at most one row per member.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_key
from .graph import components

BITS = 64
CHUNK = 1 << 16  # shingles whose bits are counted at once
DEALT = 1 << 12  # fingerprints whose probe rows are made at once


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), dtype="<u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, CHUNK):
        part = np.unpackbits(h[i:i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, th, fp): fp is the signed long of the fingerprint, th a hash of the text."""
    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))],
                                             names=["doc_id", "th", "fp"])
    return docs.select("doc_id", text_key().alias("th"), "text").mapInArrow(run, "doc_id long, th long, fp long")


# -- partitions and thresholds (driver side, tables of fixed size) --------------------------------

def bit_partitions(pairs: np.ndarray, n: float, parts: int = 4) -> list[list[int]]:
    """Group the 64 bits into ``parts`` equal groups of correlated bits, greedily.

    ``pairs[i, j]`` counts fingerprints with bits i and j both set.
    """
    p = np.diag(pairs) / n
    cov = pairs / n - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for _ in range(parts):
        rest = sorted(left)
        group = [max(rest, key=lambda i: corr[i, rest].sum())]
        left.remove(group[0])
        while len(group) < BITS // parts:
            best = max(sorted(left), key=lambda j: corr[j, group].mean())
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def project(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value of the listed bits of each fingerprint, as int64."""
    out = np.zeros(len(fp), dtype=np.int64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def within(hist: np.ndarray, width: int, most: int) -> np.ndarray:
    """counts[t][v]: rows of the histogram whose value is within distance t of v."""
    exact = np.zeros((most + 1, len(hist)))
    exact[0] = hist
    v = np.arange(len(hist))
    for b in range(width):
        flipped = exact[:, v ^ (1 << b)]
        exact[1:] += flipped[:-1]
    return np.cumsum(exact, axis=0)


def masks(width: int, most: int) -> list[np.ndarray]:
    """masks[t]: every value with at most t bits set, fewest first."""
    v = np.arange(1 << width, dtype=np.int64)
    ones = np.bitwise_count(v)
    return [np.concatenate([v[ones == k] for k in range(t + 1)]) for t in range(most + 1)]


def allocate(costs: list[np.ndarray], distance: int) -> np.ndarray:
    """Thresholds (rows x parts) with sum = distance - parts + 1 and the least total cost.

    ``costs[i]`` is (rows x (distance + 2)): the cost of threshold -1, 0, ..., distance. The
    dynamic program runs over partitions; its state is sum(t_i + 1) so far, distance + 1 at the end.
    """
    rows, total = len(costs[0]), distance + 1
    best = np.full((rows, total + 1), np.inf)
    best[:, 0] = 0
    taken = []
    for cost in costs:
        after = np.full_like(best, np.inf)
        choice = np.zeros(best.shape, dtype=np.int8)
        for s in range(total + 1):
            for t in range(s + 1):
                c = best[:, s - t] + cost[:, t]
                better = c < after[:, s]
                after[better, s] = c[better]
                choice[better, s] = t
        best = after
        taken.append(choice)
    at = np.full(rows, total)
    out = np.zeros((rows, len(costs)), dtype=np.int8)
    for i in range(len(costs) - 1, -1, -1):
        t = taken[i][np.arange(rows), at]
        out[:, i] = t - 1
        at = at - t
    return out


# -- verification -----------------------------------------------------------------------------------

def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b): (node, smallest node of its component) without roots."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[:len(a)], inv[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def verified(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, distance: int, most: int = 1 << 21):
    """Verified links among rows that share a key, yielded as forests of at most ``most`` pairs each."""
    order = np.lexsort((probe, key))
    key, fp, probe = key[order], fp[order].view(np.uint64), probe[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[starts[1:], len(key)]
    held = np.add.reduceat(~probe, starts) if len(key) else starts  # index rows come first in a key
    size = ends - starts
    group = np.repeat(np.arange(len(starts)), size)
    asks = np.flatnonzero(probe & (held[group] > 0))
    if not len(asks):
        return
    work = np.cumsum(held[group[asks]])
    i = 0
    while i < len(asks):
        j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + most, side="right")))
        q, n = asks[i:j], held[group[asks[i:j]]]
        first = np.repeat(starts[group[q]] - (np.cumsum(n) - n), n)
        idx = first + np.arange(n.sum())
        a, b = np.repeat(fp[q], n), fp[idx]
        ok = (a != b) & (np.bitwise_count(a ^ b) <= distance)
        if ok.any():
            yield forest(a[ok].view(np.int64), b[ok].view(np.int64))
        i = j


def grouped(batches, rows: int = 1 << 18):
    """Join sorted Arrow batches into pieces that never cut a key (column 0)."""
    held: list = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))  # the last key may go on
        if cut:
            yield table.slice(0, cut)
        held, n = table.slice(cut).to_batches(), table.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)


def links(fps: DataFrame, distance: int = 3, parts: int = 4, block: int = 4096) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints ``fps`` (fp) within ``distance`` bits."""
    spark, width = fps.sparkSession, BITS // parts

    def pairs_of_bits(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1,
                                 bitorder="little").astype(np.float32)
            for i in range(0, len(bits), CHUNK):
                total += bits[i:i + CHUNK].T @ bits[i:i + CHUNK]
        if total.any():
            i, j = np.triu_indices(BITS)
            yield pa.RecordBatch.from_arrays([pa.array((i * BITS + j).astype(np.int32)),
                                              pa.array(total[i, j].astype(np.int64))], names=["ij", "n"])

    rows = fps.mapInArrow(pairs_of_bits, "ij int, n long").groupBy("ij").agg(F.sum("n")).collect()  # <= 2080 rows
    pairs = np.zeros((BITS, BITS))
    for ij, n in rows:
        pairs[ij // BITS, ij % BITS] = pairs[ij % BITS, ij // BITS] = n
    groups = bit_partitions(pairs, max(1, fps.count()), parts)

    def values(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([(i << width) + project(fp, g) for i, g in enumerate(groups)]))], names=["v"])

    hist = np.zeros((parts, 1 << width))
    for v, n in fps.mapInArrow(values, "v long").groupBy("v").count().collect():  # <= parts * 2^width rows
        hist[v >> width, v & ((1 << width) - 1)] = n
    mask = masks(width, distance)
    near = [within(h, width, distance) for h in hist]
    cost = [np.vstack([np.zeros((1, 1 << width)), w + np.array([[len(m)] for m in mask])]).astype(np.float32).T
            for w in near]  # a probe row costs about as much as a verified candidate
    blocks = [np.maximum(1, -(-h // block)).astype(np.int32) for h in hist]
    asked = [np.maximum(1, -(-w[min(1, distance)] // (8 * block))).astype(np.int32) for w in near]
    # Fixed size whatever the corpus: parts * 2^width values, about 8 MB.
    plan = spark.sparkContext.broadcast((groups, cost, blocks, asked, mask, hist > 0))

    def deal(batches):
        groups, cost, blocks, asked, mask, held = plan.value
        for batch in batches:
            for at in range(0, batch.num_rows, DEALT):
                fp = batch.column(0).slice(at, DEALT).to_numpy().view(np.uint64)
                proj = [project(fp, g) for g in groups]
                t = allocate([c[p] for c, p in zip(cost, proj)], distance)
                for i, p in enumerate(proj):
                    for ask in (False, True):
                        # An index row goes to one block and every copy of the askers', a probe row to
                        # one copy and every block, so each pair meets once.
                        if ask:
                            who = [np.flatnonzero(t[:, i] == k) for k in range(distance + 1)]
                            src = np.concatenate([np.repeat(w, len(mask[k])) for k, w in enumerate(who)])
                            val = np.concatenate([(p[w][:, None] ^ mask[k][None, :]).ravel() for k, w in enumerate(who)])
                            live = held[i][val]
                            src, val = src[live], val[live]
                        else:
                            src, val = np.arange(len(fp)), p
                        own, other = (asked, blocks) if ask else (blocks, asked)
                        mine = ((fp[src] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % own[i][val]
                        n = other[i][val]
                        src, val, mine = np.repeat(src, n), np.repeat(val, n), np.repeat(mine, n)
                        others = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)
                        b, c = (others, mine) if ask else (mine, others)
                        key = (((i << width) + val) << 40) + (b << 20) + c
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[src].view(np.int64)),
                                                          pa.array(np.full(len(src), ask))], names=["key", "fp", "ask"])

    def verify(batches):
        for table in grouped(batches):
            key, fp, ask = (table.column(c).to_numpy() for c in ("key", "fp", "ask"))
            for a, b in verified(key, fp, ask, distance):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = fps.select("fp").mapInArrow(deal, "key long, fp long, ask boolean")
    return (dealt.repartition("key").sortWithinPartitions("key")
            .mapInArrow(verify, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, parts: int = 4) -> DataFrame:
    """(doc_id, th, fp, component_id, root) for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable over links of at most ``distance`` differing
    bits, the row itself included; ``root`` is the component's smallest fingerprint. A text that is null, empty or without words has fingerprint 0
    and links like any other. A null doc_id never names a component unless all its ids are null.
    Repeated rows stay, with equal results; an empty table gives no rows; other columns are ignored.
    """
    table = staged(fingerprints(docs, shingle), "fingerprints")
    distinct = staged(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    joined = components(links(distinct.select("fp"), distance, parts))
    named = staged(distinct.join(joined, distinct.fp == joined.node, "left")
                   .select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return table.join(named.join(least, "root").select("fp", "component_id", "root"), "fp") \
        .select("doc_id", "th", "fp", "component_id", "root")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest doc_id stays.

    Ties (the same doc_id with different texts) go to the smaller text hash; of fully repeated
    rows one stays, with the least of the other columns' values row by row. Null ids come last.
    """
    found = staged(near_duplicates(docs, shingle, distance), "components")
    # One row per component; map-side partial aggregation, so a hot component stays cheap.
    best = found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("k"))
    kept = best.select(F.col("k.doc_id").alias("__id"), F.col("k.th").alias("__key"))
    rows = found.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__key"))) \
        .groupBy("__id", "__key").agg(F.count("*").alias("__n"))
    rows = staged(rows, "kept")
    out = docs.withColumn("__th", text_key())
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__key"))
    single = out.join(rows.where("__n = 1"), on, "left_semi").select(*docs.columns)
    many = out.join(rows.where("__n > 1"), on, "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return single.union(many.groupBy("doc_id", "__th").agg(F.min(whole).alias("r")).select("r.*"))
