"""Nearest neighbours by inner product over balanced posting lists (after Chen et al., "SPANN", 2021).

* Equal vectors form one class (native aggregation; its smallest k + 1 ids are all that a top k can
  need), so copies neither flood a list nor a task.
* Inner product becomes Euclidean distance by one more coordinate, sqrt(M^2 - |x|^2).
* Centroids are fitted on a bounded sample (``sample`` classes, by hash of the id) by k-means with a
  size penalty, so lists stay balanced; their number grows with the square root of the classes.
* A graph over the centroids, searched in memory by a vectorised beam search, routes vectors and
  queries. A vector goes to its nearest list and to every other one almost as near (boundary replicas);
  a query probes all lists within a distance ratio of its nearest, however many: the beam widens until
  it has passed the ratio (to its nearest, or to the median of such distances if its own is smaller). The ratio is
  the one at which queries of the sample find a stated share of their neighbours there (``recall``). Queries are routed at the length of the longest vector, as the order
  by inner product does not depend on their own.
* Lists near each other are bundled. Vectors and queries travel once a bundle, with the lists they belong to,
  and meet on (bundle, vector block, query block); blocks have a bounded size, so a large list is spread over
  tasks. A task scores list by list, only the vectors of a list against the queries that probe it, and
  emits the best per query of all its blocks.

Every row is indexed; only centroids and the ratio are fitted on the sample. On vectors without clusters the ratio
takes many lists, and the work nears that of all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .simhash import grouped


class Graph:
    """Centroids with a neighbour graph; ``search`` is a beam search for many points at once."""

    def __init__(self, centroids: np.ndarray, degree: int = 24, seed: int = 1):
        self.c = centroids
        n = len(centroids)
        self.sq = (centroids ** 2).sum(axis=1)
        rng = np.random.default_rng(seed)
        near = np.empty((n, min(degree, n)), dtype=np.int32)
        for i in range(0, n, 1024):
            d = self.sq[None, :] - 2 * centroids[i:i + 1024] @ centroids.T
            near[i:i + 1024] = np.argsort(d, axis=1, kind="stable")[:, :near.shape[1]]
        far = rng.integers(0, n, (n, min(8, n)), dtype=np.int32)  # long links keep the graph connected
        self.links = np.concatenate([near, far], axis=1)
        self.entry = rng.choice(n, size=min(n, 64), replace=False).astype(np.int32)

    def search(self, x: np.ndarray, want: int, beam: int = 64, rounds: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of about the ``want`` nearest centroids of each row of ``x``, nearest first."""
        beam = max(beam, 2 * want)
        q = len(x)
        sq = (x ** 2).sum(axis=1)
        if 4 * want >= len(self.c):  # such a beam costs no less than all distances
            dist = self.sq[None, :] - 2 * x @ self.c.T
            ids = np.argsort(dist, axis=1, kind="stable")[:, :want].astype(np.int32)
            return ids, np.sqrt(np.maximum(np.take_along_axis(dist, ids, axis=1) + sq[:, None], 0))
        ids = np.repeat(self.entry[None, :], q, axis=0)
        dist = self.sq[ids] - 2 * x @ self.c[self.entry].T
        seen = np.zeros((q, len(self.c)), dtype=bool)
        seen[:, self.entry] = True
        open_ = np.ones(ids.shape, dtype=bool)
        for _ in range(max(rounds, beam // 4)):
            step = np.where(open_, dist, np.inf)
            pick = np.argpartition(step, 7, axis=1)[:, :8]  # expand the best unexpanded
            if not np.isfinite(np.take_along_axis(step, pick, axis=1)).any():
                break
            np.put_along_axis(open_, pick, False, axis=1)
            new = np.sort(self.links[np.take_along_axis(ids, pick, axis=1)].reshape(q, -1), axis=1)
            fresh = ~np.take_along_axis(seen, new, axis=1)
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            row, col = np.nonzero(fresh)  # only these are measured, each once
            who = new[row, col]
            seen[row, who] = True
            nd = np.full(new.shape, np.inf)
            nd[row, col] = self.sq[who] - 2 * np.einsum("nd,nd->n", x[row], self.c[who])
            ids, dist = np.concatenate([ids, new], axis=1), np.concatenate([dist, nd], axis=1)
            open_ = np.concatenate([open_, fresh], axis=1)
            order = np.argpartition(dist, min(beam, dist.shape[1]) - 1, axis=1)[:, :beam]
            ids, dist, open_ = (np.take_along_axis(a, order, axis=1) for a in (ids, dist, open_))
        order = np.argsort(dist, axis=1, kind="stable")[:, :want]
        ids, dist = np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)
        return ids, np.sqrt(np.maximum(dist + sq[:, None], 0))

    def within(self, x: np.ndarray, ratio: float, base: float, size: np.ndarray, least: int):
        """Yield (rows, centroids) of all centroids of each row of ``x`` that are within ``ratio`` of its nearest.

        A row nearer than ``base`` to a centroid counts as being that far: its ratio would say nothing. A row gets further ones until the ``size`` of those it has adds up to ``least``.
        """
        todo, want = np.arange(len(x)), 64
        while len(todo):
            ids, d = self.search(x[todo], want)
            before = np.cumsum(size[ids], axis=1) - size[ids]
            take = np.isfinite(d) & ((d <= ratio * np.maximum(d[:, :1], base)) | (before < least))
            done = ~take[:, -1] if want < len(self.c) else np.ones(len(todo), dtype=bool)
            row, col = np.nonzero(take & done[:, None])
            yield todo[row], ids[row, col]
            todo, want = todo[~done], 2 * want


def balanced_kmeans(x: np.ndarray, k: int, rounds: int = 8, weight: float = 0.5, seed: int = 3) -> np.ndarray:
    """k centroids of ``x``, points of one length; a cluster's cost rises with its size in the round before.

    Centroids get that length too: a mean of scattered points is short, hence near to every query, and its
    list would be probed by all and filled with replicas.
    """
    radius = np.sqrt((x ** 2).sum(axis=1).max(initial=0.0))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=k, replace=False)].copy()
    size = np.full(k, len(x) / k)
    for _ in range(rounds):
        who = np.empty(len(x), dtype=np.int64)
        for i in range(0, len(x), 4096):
            d = (c ** 2).sum(axis=1)[None, :] - 2 * x[i:i + 4096] @ c.T + (x[i:i + 4096] ** 2).sum(axis=1)[:, None]
            d += weight * d.min(axis=1).mean() * (size / (len(x) / k) - 1)[None, :]
            who[i:i + 4096] = d.argmin(axis=1)
        size = np.bincount(who, minlength=k).astype(float)
        total = np.zeros_like(c)
        np.add.at(total, who, x)
        empty = size == 0
        c = np.where(empty[:, None], x[rng.choice(len(x), size=k)], total / np.maximum(size, 1)[:, None])
        length = np.sqrt((c ** 2).sum(axis=1, keepdims=True))
        c = np.where(length > 0, c * (radius / np.maximum(length, 1e-300)), c)
    return c


def bundled_order(c: np.ndarray, size: int) -> np.ndarray:
    """An order of the centroids in which neighbours are near: halves along the line between two far ones, down to ``size``."""
    todo, out = [np.arange(len(c))], []
    while todo:
        part = todo.pop()
        if len(part) <= size:
            out.append(part)
            continue
        x = c[part]
        a = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        b = x[((x - a) ** 2).sum(axis=1).argmax()]
        order = np.argsort(x @ (b - a), kind="stable")
        half = -(-len(part) // (2 * size)) * size
        todo += [part[order[half:]], part[order[:half]]]
    return np.concatenate(out) if out else np.arange(0)


def measured_ratio(graph: Graph, vectors: np.ndarray, queries: np.ndarray, own: np.ndarray, real: np.ndarray, k: int, near: float,
                   replicas: int, recall: float) -> tuple[float, float]:
    """(ratio, base): the distance ratio at which ``queries`` find ``recall`` of their k nearest among ``vectors``.

    Ratios are to the distance of the nearest centroid, or to ``base``, its median, where that is larger. ``vectors`` and
    ``queries`` are lifted, ``real`` are the vectors as they are, ``own`` is each query's row there.
    """
    if len(vectors) < 3 or not len(queries):
        return 1.0, 0.0
    ids, d = [], []
    for i in range(0, len(vectors), 512):
        part = vectors[i:i + 512]
        far = np.sqrt(np.maximum((part ** 2).sum(axis=1)[:, None] + graph.sq[None, :] - 2 * part @ graph.c.T, 0))
        ids.append(np.argsort(far, axis=1, kind="stable")[:, :replicas])
        d.append(np.take_along_axis(far, ids[-1], axis=1))
    ids, d = np.concatenate(ids), np.concatenate(d)
    held = d <= near * d[:, :1]
    need, nearest = [], []
    for q, i in zip(queries, own):
        s = real @ real[i]
        s[i] = -np.inf
        best = np.argpartition(-s, min(k, len(s) - 1) - 1)[:min(k, len(s) - 1)]
        far = np.sqrt(np.maximum(((graph.c - q) ** 2).sum(axis=1), 0))
        need.append(np.where(held[best], far[ids[best]], np.inf).min(axis=1))  # the nearest list that holds each
        nearest.append(far.min())
    base = float(np.median(nearest))
    ratio = np.array(need) / np.maximum(np.maximum(nearest, base), 1e-12)[:, None]
    return float(max(1.0, np.quantile(ratio, recall, method="higher"))), base


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, e): distinct rows with an id and a finite, non-zero vector of the table's main dimension."""
    ok = F.expr("vec_id IS NOT NULL AND size(embedding) > 0 AND exists(embedding, x -> x != 0) AND "
                "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    rows = vectors.where(ok).select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    main = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("e") == (main["d"] if main else 0)).distinct()


def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """(cid, e, ids): one row per distinct vector with its ``keep`` smallest ids, ascending.

    The smallest ids come from a tournament over salts, so a vector that a third of the rows share is
    never gathered in one task.
    """
    for salts in (64, 8, 1):
        by = Window.partitionBy("e", *(["s"] if salts > 1 else [])).orderBy("vec_id")
        rows = (rows.withColumn("s", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
                .withColumn("r", F.row_number().over(by)).where(F.col("r") <= keep).select("vec_id", "e"))
    out = rows.groupBy("e").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return staged(out.select(F.monotonically_increasing_id().alias("cid"), "e", "ids"), "classes")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, is_query, k: int = 20, sample: int = 32768, near: float = 1.15, probe: float | None = None,
           replicas: int = 2, least_classes: int = 0, block: int = 2048, bundle: int = 16, recall: float = 0.98, counted=None) -> DataFrame:
    """The ``k`` candidates of largest inner product for every row where ``is_query`` (a condition on vec_id).

    (query_id, rank, vec_id, score), nearest first, ties to the smaller vec_id; every row but the
    query's own is a candidate, all of them are returned if there are fewer than k. ``score`` is the
    inner product of the original vectors in double precision. Null ids, and vectors that are null,
    empty, zero, of another dimension than most, or hold null or non-finite components take no part.
    Repeated rows count once. Lists are used at any size; up to ``least_classes`` distinct vectors form
    one list (exact search). ``bundle`` lists share the rows that carry their vectors and queries. ``probe`` is the
    distance ratio; without one it is measured on 256 vectors of the sample for a share of ``recall``. ``counted``
    is an accumulator for the pairs that were scored.
    """
    spark = vectors.sparkSession
    rows = staged(valid_vectors(vectors), "vectors")
    classes = classes_of(rows, k + 1)
    asked = rows.where(is_query).join(classes.select("cid", "e"), "e").select("vec_id", "cid")
    asked = staged(asked, "asked")
    norm = F.expr("aggregate(e, 0D, (a, x) -> a + x * x)")
    n, most = classes.agg(F.count("*"), F.max(norm)).first()
    most = most or 0.0
    lists = 1 if n <= least_classes else max(1, int(2 * n ** 0.5))
    picked = classes.orderBy(F.xxhash64("cid"), "cid").limit(sample if lists > 1 else 1).select("e").collect()  # bounded
    x = np.array([r.e for r in picked]) if picked else np.zeros((1, 1))

    def lifted(v: np.ndarray, query: bool) -> np.ndarray:
        if query:
            v = v / np.abs(v).max(axis=1, keepdims=True)
            v = v * (most ** 0.5 / np.linalg.norm(v, axis=1, keepdims=True))
        more = np.zeros(len(v)) if query else np.sqrt(np.maximum(most - (v ** 2).sum(axis=1), 0))
        return np.concatenate([v, more[:, None]], axis=1)

    centroids = balanced_kmeans(lifted(x, False), min(lists, len(x)))
    built = Graph(centroids[bundled_order(centroids, bundle)])
    graph = spark.sparkContext.broadcast(built)  # lists x dimension
    base = 0.0
    if probe is None:
        tried = np.random.default_rng(5).permutation(len(x))[:256] if lists > 1 else []
        probe, base = measured_ratio(built, lifted(x, False), lifted(x[tried], True) if len(tried) else x[:0], tried, x, k, near, replicas, recall)

    def bundled(row: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(rows, bundles, lists): the pairs (row, list) as one entry per row and bundle."""
        order = np.lexsort((ids, row))
        row, ids = row[order], ids[order].astype(np.int32)
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (ids[1:] // bundle != ids[:-1] // bundle)]) if len(row) else row
        held = pa.ListArray.from_arrays(pa.array(np.r_[new, len(row)], pa.int32()), pa.array(ids, pa.int32()))
        return row[new], ids[new] // bundle, held

    def post(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, d = graph.value.search(lifted(_matrix(part.column(1)), False), replicas)
                row, col = np.nonzero(d <= near * d[:, :1])
                row, pack, held = bundled(row, ids[row, col])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pack.astype(np.int64)), *(part.column(i).take(take) for i in range(3)), held,
                     pa.array(ids[row, 0].astype(np.int32))],
                    names=["bundle", "cid", "e", "ids", "lists", "nearest"])

    postings = staged(classes.mapInArrow(
        post, "bundle long, cid long, e array<double>, ids array<long>, lists array<int>, nearest int"), "postings")
    sizes = np.zeros(len(graph.value.c), dtype=np.int64)  # of the lists, each class in its nearest one
    for c, m in postings.where(F.array_contains("lists", F.col("nearest"))).groupBy("nearest").count().collect():
        sizes[c] = m
    held_sizes = spark.sparkContext.broadcast(sizes)

    def route(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for row, ids in graph.value.within(lifted(_matrix(part.column(1)), True), probe, base, held_sizes.value, 4 * (k + 1)):
                    row, pack, held = bundled(row, ids)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pack.astype(np.int64)), part.column(0).take(take), part.column(1).take(take), held],
                        names=["bundle", "cid", "e", "lists"])

    asking = classes.join(asked.select("cid").distinct(), "cid", "left_semi").select("cid", "e")
    routed = staged(asking.mapInArrow(route, "bundle long, cid long, e array<double>, lists array<int>"), "routed")
    counts = np.ones((len(sizes) // bundle + 1, 2), dtype=np.int64)
    for side, met in enumerate((postings, routed)):
        for c, m in met.groupBy("bundle").count().collect():  # one row per bundle
            counts[c, side] = -(-m // block)
    dealt = spark.sparkContext.broadcast(counts)

    def deal(query: bool):
        def run(batches):
            for batch in batches:
                c = batch.column(0).to_numpy()
                own = (batch.column(1).to_numpy() * 2654435761 >> 8) % dealt.value[c, int(query)]
                m = dealt.value[c, int(not query)]
                row = np.repeat(np.arange(len(c)), m)
                other = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
                v, q = (other, own[row]) if query else (own[row], other)
                take = pa.array(row)
                ids = pa.nulls(len(row), pa.list_(pa.int64())) if query else batch.column(3).take(take)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((c[row] << 40) + (v << 20) + q), pa.array(np.full(len(row), query)),
                     batch.column(1).take(take), batch.column(2).take(take), ids, batch.column(3 if query else 4).take(take)],
                    names=["key", "ask", "cid", "e", "ids", "lists"])
        return run

    def member(lists: pa.ListArray) -> np.ndarray:
        """0/1 matrix: which of its bundle's lists each row has."""
        out = np.zeros((len(lists), bundle), dtype=np.float32)
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        out[row, lists.flatten().to_numpy(zero_copy_only=False) % bundle] = 1
        return out

    def merged(batches):
        """The best of what a task has found; a query's earlier rows make way before they are shuffled."""
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 1 << 18:
                held = reduced(held)
                n = sum(x.num_rows for x in held)
                if n >= 1 << 17:
                    yield from held
                    held, n = [], 0
        if held:
            yield from reduced(held)

    def reduced(held):
        table = pa.Table.from_batches(held).combine_chunks()
        q, cid, score = (table.column(c).to_numpy() for c in range(3))
        first = pc.list_element(table.column("ids"), 0).to_numpy()
        order = np.lexsort((first, -score, q))  # equal classes of a query come together
        q, cid = q[order], cid[order]
        new = np.r_[True, (q[1:] != q[:-1]) | (cid[1:] != cid[:-1])]
        order, q = order[new], q[new]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        return table.take(pa.array(order[rank <= k])).combine_chunks().to_batches(max_chunksize=1 << 14)

    def best(batches):
        yield from merged(scored(batches))

    def scored(batches):
        for table in grouped(batches, 4 * block):
            table = table.combine_chunks()
            key = table.column("key").to_numpy()
            bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            ask = table.column("ask").to_numpy(zero_copy_only=False)
            cid = table.column("cid").to_numpy()
            e = _matrix(table.column("e").combine_chunks())
            ids = table.column("ids").combine_chunks()
            lists = member(table.column("lists").combine_chunks())
            for a, b in zip(bounds, bounds[1:]):
                v, asks = a + np.flatnonzero(~ask[a:b]), a + np.flatnonzero(ask[a:b])
                for at in range(0, len(asks) if len(v) else 0, 512):
                    yield best_of(asks[at:at + 512], v, cid, e, ids, lists)

    def best_of(q, v, cid, e, ids, lists):
        """The k + 1 best of the vectors ``v`` for each query of ``q``, from the lists they share."""
        first = pc.list_element(ids.take(pa.array(v)), 0).to_numpy(zero_copy_only=False)
        # What rounding may do to a product; within it the cut is made on the exact scores below.
        slack = 8 * e.shape[1] * np.finfo(float).eps * np.sqrt((e[q] ** 2).sum(axis=1) * (e[v] ** 2).sum(axis=1).max())
        floor, rows, cols = np.full(len(q), -np.inf), [], []
        for at in np.flatnonzero((lists[q].sum(axis=0) > 0) & (lists[v].sum(axis=0) > 0)):
            qi, vi = np.flatnonzero(lists[q, at]), np.flatnonzero(lists[v, at])
            s = e[q[qi]] @ e[v[vi]].T
            if counted is not None:
                counted.add(s.size)
            if s.shape[1] > k:
                floor[qi] = np.maximum(floor[qi], np.partition(s, s.shape[1] - k - 1, axis=1)[:, -k - 1] - slack[qi])
            i, j = np.nonzero(s >= floor[qi][:, None])
            rows.append(qi[i])
            cols.append(vi[j])
        pairs = np.unique(np.concatenate(rows) * len(v) + np.concatenate(cols)) if rows else np.empty(0, dtype=np.int64)
        row, col = pairs // len(v), pairs % len(v)
        score = (e[q[row]] * e[v[col]]).sum(axis=1)
        order = np.lexsort((first[col], -score, row))
        start = np.searchsorted(row[order], row[order])
        order = order[np.arange(len(order)) - start <= k]
        qi, vi = q[row[order]], v[col[order]]
        return pa.RecordBatch.from_arrays([pa.array(cid[qi]), pa.array(cid[vi]), pa.array(score[order]), ids.take(pa.array(vi))],
                                          names=["q", "cid", "score", "ids"])

    schema = "key long, ask boolean, cid long, e array<double>, ids array<long>, lists array<int>"
    met = postings.select("bundle", "cid", "e", "ids", "lists").mapInArrow(deal(False), schema) \
        .union(routed.mapInArrow(deal(True), schema))
    found = (met.repartition("key").sortWithinPartitions("key")
             .mapInArrow(best, "q long, cid long, score double, ids array<long>"))
    # A replicated class may come from several bundles, always with the same score.
    found = found.groupBy("q", "cid").agg(F.first("score").alias("score"), F.first("ids").alias("ids"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id"))
    few = Window.partitionBy("q").orderBy(F.desc("score"), F.expr("ids[0]"))
    found = found.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1)
    found = found.select("q", "score", F.explode("ids").alias("vec_id")).distinct()
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    found = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    out = asked.withColumnRenamed("vec_id", "query_id").join(found, F.col("cid") == F.col("q"))
    own = F.expr(f"slice(filter(best, x -> x.vec_id != query_id), 1, {k})")
    return (out.select("query_id", F.posexplode(own).alias("at", "b"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score")))
