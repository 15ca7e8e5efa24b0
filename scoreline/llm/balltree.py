"""Exact top k by inner product: ball trees per shard, branch and bound (after Ram and Gray, 2012).

* Components become integers, floor(scale * x), so scores are integers and ties are real. Equal vectors
  form one class with its smallest k + 1 ids: all that any top k can need of them.
* A coarse tree, fitted on a bounded sample (``sample`` classes, at most ``MOST_CELLS`` leaves), sends every
  class to a cell of space; a cell with more rows than a shard holds is dealt over slices. Only where rows
  lie depends on the sample, not what is found: each cell's radius is measured over all its rows.
* A shard is searched with a ball tree of its own. An inner product with any vector of a ball is at most
  <q, centre> + |q| radius, so nodes whose bound is below the query's kth score are cut, and leaves
  are visited in the order of their bounds until the next bound is below it.
* The current kth score is shared between shards: a query goes to its cell of highest bound first,
  then to the next few, then to all whose bound still reaches the kth score that it has by then. The
  score travels with the query, so nothing that grows is broadcast.

A cell that many queries visit is split by query (parts) as well as by rows (slices).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .simhash import grouped
from .vectors import best_first, integer_classes, matrix, products, quantised, ragged

MOST_CELLS = 4096
NONE = -(1 << 63)  # the kth score of a query that has not k yet


def slack(size: np.ndarray) -> np.ndarray:
    """What rounding may take from a bound whose terms add up to ``size``."""
    return 1e-9 * size + 1e-6


def reached(kth: np.ndarray) -> np.ndarray:
    """What a bound must reach to matter."""
    return np.where(kth == NONE, -np.finfo(np.float64).max, kth.astype(np.float64))


def bounds(q: np.ndarray, length: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Upper bounds (queries x balls) of the inner product of each query with any vector of each ball."""
    far = length[:, None] * (radius + np.sqrt((centre ** 2).sum(axis=1)))[None, :]
    return q @ centre.T + length[:, None] * radius[None, :] + slack(far)


def split_direction(x: np.ndarray) -> np.ndarray:
    """The line between two far points of ``x``: the farthest from the mean and the farthest from that."""
    a = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    return x[((x - a) ** 2).sum(axis=1).argmax()] - a


class Cells:
    """A coarse tree over a sample: ``place`` gives the cell of any vector."""

    def __init__(self, x: np.ndarray, cells: int):
        self.depth = max(cells - 1, 0).bit_length()
        self.line = np.zeros((1 << self.depth, x.shape[1]))
        self.cut = np.zeros(1 << self.depth)
        parts = [x]
        for level in range(self.depth):
            halves = []
            for i, p in enumerate(parts):
                node = (1 << level) + i
                if len(p):
                    self.line[node] = split_direction(p)
                    along = p @ self.line[node]
                    self.cut[node] = np.median(along)
                    halves += [p[along <= self.cut[node]], p[along > self.cut[node]]]
                else:
                    halves += [p, p]
            parts = halves
        self.centre = np.array([p.mean(axis=0) if len(p) else np.zeros(x.shape[1]) for p in parts])

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to the cell's centre) of each row of ``x``."""
        node = np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (np.einsum("nd,nd->n", x, self.line[node]) > self.cut[node])
        cell = node - (1 << self.depth)
        return cell, np.sqrt(((x - self.centre[cell]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-6


class BallTree:
    """A balanced tree over the rows of ``x``: one level of equally many balls after the other."""

    def __init__(self, x: np.ndarray, leaf: int = 64):
        self.x = x
        real = x.astype(np.float64)
        parts = [np.arange(len(x))]
        self.levels = []  # (centres, radii) from the root to the leaves
        while True:
            centre = np.array([real[p].mean(axis=0) if len(p) else np.zeros(x.shape[1]) for p in parts])
            radius = np.array([np.sqrt(((real[p] - c) ** 2).sum(axis=1).max(initial=0.0)) for p, c in zip(parts, centre)])
            self.levels.append((centre, radius * (1 + 1e-9)))
            if max(map(len, parts)) <= leaf:
                break
            halves = []
            for p in parts:
                if len(p) < 2:
                    halves += [p, p[:0]]
                    continue
                order = np.argpartition(real[p] @ split_direction(real[p]), len(p) // 2)
                halves += [p[order[:len(p) // 2]], p[order[len(p) // 2:]]]
            parts = halves
        self.leaves = parts

    def search(self, q: np.ndarray, kth: np.ndarray, ids: pa.ListArray, keep: int):
        """The ``keep`` best (row of q, score, vec_id) per query among scores of at least its ``kth``; pairs scored.

        ``ids`` are the vec_ids of each row of x.
        """
        real = q.astype(np.float64)
        length = np.sqrt((real ** 2).sum(axis=1))
        kth, scored = kth.copy(), 0
        live = np.ones((len(q), 1), dtype=bool)
        for centre, radius in self.levels:
            live = np.repeat(live, len(centre) // live.shape[1], axis=1)
            bound = np.where(live, bounds(real, length, centre, radius), -np.inf)
            live = bound >= reached(kth)[:, None]
        order = np.argsort(-bound, axis=1, kind="stable")
        row, score, vec = (np.empty(0, dtype=np.int64) for _ in range(3))
        at, width = 0, 1
        while at < order.shape[1]:
            leaf = order[:, at:at + width]
            who, col = np.nonzero(np.take_along_axis(bound, leaf, axis=1) >= reached(kth)[:, None])
            if not len(who):  # leaves come in the order of their bounds
                break
            leaf = leaf[who, col]
            by = np.argsort(leaf, kind="stable")
            cut = np.flatnonzero(np.r_[True, leaf[by][1:] != leaf[by][:-1], True])
            news = []
            for a, b in zip(cut, cut[1:]):
                asked, held = who[by[a:b]], self.leaves[leaf[by[a]]]
                s = products(q[asked], self.x[held])
                scored += s.size
                i, j = np.nonzero(s >= kth[asked][:, None])
                more, of = ragged(ids, held[j])
                news.append((asked[i][of], s[i, j][of], more))
            row, score, vec = (np.concatenate([old, *(n[c] for n in news)]) for c, old in enumerate((row, score, vec)))
            best = best_first(row, score, vec, keep)
            row, score, vec = row[best], score[best], vec[best]
            full = np.flatnonzero(np.bincount(row, minlength=len(q)) == keep)
            last = np.searchsorted(row, full, side="right") - 1
            kth[full] = np.maximum(kth[full], score[last])
            at, width = at + width, 2 * width
        return row, score, vec, scored


def search(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, shard: int = 1 << 20, sample: int = 32768,
           leaf: int = 64, ask: int = 8192, rounds: tuple = (1, 8), counted=None) -> DataFrame:
    """The ``k`` rows of highest integer inner product for every row where ``is_query`` (a condition on vec_id).

    (query_id, rank, vec_id, score), highest score first, ties to the smaller vec_id; every row but the query's own
    is a candidate, all are returned if there are fewer than k. The result is exact. Null ids and vectors
    that are null or hold null or non-finite components take no part; zero and empty vectors do. Repeated
    rows count once; an id with several vectors is several candidates, never one of its own. Other columns
    of ``vectors`` are not read. No rows: an empty result.

    ``shard`` is the number of components of one shard's vectors, ``ask`` the number of queries searched
    in it at once, ``rounds`` the cells a query has visited after the first rounds (the last takes the rest).
    ``counted`` is an accumulator for the pairs that were scored.
    """
    spark = vectors.sparkSession
    rows = staged(quantised(vectors, scale), "integers")
    classes = integer_classes(rows, ["q"], k + 1)
    asked = staged(rows.where(is_query).join(classes.select("cid", "q"), "q").select("vec_id", "cid"), "asked")
    n, width = classes.agg(F.count("*"), F.max(F.size("q"))).first()
    size = max(leaf, shard // (width or 1))  # rows of a shard
    picked = classes.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("q").toArrow()["q"].combine_chunks()  # bounded
    x = matrix(picked).astype(np.float64) if n else np.zeros((1, 1))
    cells = spark.sparkContext.broadcast(Cells(x, min(MOST_CELLS, -(-(n or 1) // size), max(1, len(x) // 8))))  # cells x width

    def place(batches):
        for batch in batches:
            cell, far = cells.value.place(matrix(batch.column(1)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    placed = staged(classes.mapInArrow(place, "cid long, q array<long>, ids array<long>, cell long, far double"), "placed")
    radius = np.full(len(cells.value.centre), -1.0)
    slices = np.zeros(len(radius), dtype=np.int64)
    for c, m, far in placed.groupBy("cell").agg(F.count("*"), F.max("far")).collect():  # one row per cell
        radius[c], slices[c] = far, -(-m // size)
    balls = spark.sparkContext.broadcast((np.flatnonzero(slices), radius))
    queries = placed.join(asked.select("cid").distinct(), "cid", "left_semi").select("cid", "q")
    queries = staged(queries.withColumn("kth", F.lit(NONE)), "queries")

    def route(first: int, last: int | None):
        def run(batches):
            used, radius = balls.value
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    q = matrix(part.column(1)).astype(np.float64)
                    bound = bounds(q, np.sqrt((q ** 2).sum(axis=1)), cells.value.centre[used], radius[used])
                    order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                    row, col = np.nonzero(np.take_along_axis(bound, order, axis=1) >= reached(part.column(2).to_numpy())[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(used[order[row, col]]), *(c.take(pa.array(row)) for c in part.columns)],
                                                     names=["cell", "cid", "q", "kth"])
        return run

    def visit(batches):
        for table in grouped(batches, 1 << 14):
            key = table.column("key").to_numpy()
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            for a, b in zip(cut, cut[1:]):
                part = table.slice(a, b - a).combine_chunks()
                ask_ = part.column("ask").to_numpy()
                held, asks = (part.filter(pa.array(m)) for m in (~ask_, ask_))
                if not held.num_rows or not asks.num_rows:
                    continue
                lists = held.column("ids").combine_chunks()
                tree = BallTree(matrix(held.column("q").combine_chunks()), leaf)
                q, kth, cid = matrix(asks.column("q").combine_chunks()), asks.column("kth").to_numpy(), asks.column("cid").to_numpy()
                for at in range(0, len(q), 1024):
                    row, score, vec, pairs = tree.search(q[at:at + 1024], kth[at:at + 1024], lists, k + 1)
                    if counted is not None:
                        counted.add(pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(cid[at:][row]), pa.array(score), pa.array(vec)], names=["cid", "score", "vec_id"])

    order = Window.partitionBy("cid").orderBy(F.desc("score"), "vec_id")
    found = None
    steps = [0, *rounds, None]
    for first, last in zip(steps, steps[1:]):
        if first and first >= np.count_nonzero(slices):
            break
        routed = staged(queries.mapInArrow(route(first, last), "cell long, cid long, q array<long>, kth long"), "routed")
        dealt = [(c, int(slices[c]), -(-m // ask)) for c, m in routed.groupBy("cell").count().collect()]  # one row per cell
        if not dealt:
            break
        dealt = F.broadcast(spark.createDataFrame(dealt, "cell long, slices long, parts long"))  # at most MOST_CELLS rows
        key = F.expr("shiftleft(cell, 50) + shiftleft(slice, 25) + part").alias("key")
        own = F.pmod(F.xxhash64("cid"), F.col("slices"))
        mine = F.pmod(F.xxhash64("cid"), F.col("parts"))
        held = placed.join(dealt, "cell").withColumn("slice", own).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        asks = routed.join(dealt, "cell").withColumn("part", mine).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        met = (held.select(key, F.lit(False).alias("ask"), "cid", "q", "ids", F.lit(NONE).alias("kth"))
               .union(asks.select(key, F.lit(True), "cid", "q", F.lit(None).cast("array<long>"), "kth")))
        new = met.repartition("key").sortWithinPartitions("key").mapInArrow(visit, "cid long, score long, vec_id long")
        new = new if found is None else found.union(new)
        found = staged(new.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r"), "found")
        kth = found.groupBy("cid").agg(F.count("*").alias("m"), F.min("score").alias("least")).where(F.col("m") == k + 1)
        queries = staged(queries.drop("kth").join(kth, "cid", "left").select("cid", "q", F.coalesce("least", F.lit(NONE)).alias("kth")), "queries")
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = found.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct(F.bitwise_not("score").alias("low"), "vec_id", "score"))).alias("best"))
    others = F.expr(f"slice(filter(best, x -> x.vec_id != query_id), 1, {k})")
    return (asked.withColumnRenamed("vec_id", "query_id").join(best, "cid").select("query_id", F.posexplode(others).alias("at", "b"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score")))
