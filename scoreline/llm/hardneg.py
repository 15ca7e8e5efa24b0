"""Hard negatives by exact integer scores, with Kronecker-packed products.

* Components become integers, floor(scale * x). The components of several candidates are biased to be
  non-negative and laid side by side into the fields of one wide integer per component; one product per
  anchor component then yields the scores of all of them, and the fields are unpacked after taking the
  bias back (``Fields``). Fields are as wide as the lengths of the vectors prove necessary.
* Rows that agree in label and vector form one class with its smallest ids: all that any list needs.
* Anchors lie in blocks, candidates in groups; a task holds one block and streams one group past it in
  pieces of bounded size, keeping only the best of each anchor. Neither a hot label nor a vector that a
  third of the rows share is ever in one task. Positives meet the candidates of their label only,
  negatives all others; both are a query set against all rows, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .vectors import FITS, best_first, integer_classes, longest, matrix, quantised, ragged, saturated

PIECE = 4096  # candidates that are packed at once
AT_ONCE = 256  # anchors that meet a piece at once
LOW = -(1 << 63)


class Fields:
    """Candidates (rows of ``c``) packed for products with anchors no longer than ``anchor``.

    A score is at most |a| |c|, so a field of ``width`` bits holds score + ``off``. A wide integer below
    2^53 is exact in a double, and so is every partial sum of |a| |wide| below it; as many fields are
    taken as that allows. Where not one fits, Python's integers hold three.
    """

    def __init__(self, c: np.ndarray, anchor: float):
        self.n, self.off = len(c), int(anchor * longest(c)) + 1
        self.width = (2 * self.off).bit_length()
        self.bias = -int(c.min(initial=0))
        top = float(self.bias) + float(c.max(initial=0))
        one = 2 * (anchor + 1) * c.shape[1] ** 0.5 * top  # no less than |a| |wide| of one field
        fit = [f for f in range(1, 9) if one * 2.0 ** (self.width * (f - 1)) < FITS and self.width * f < 53]
        self.kind, self.fields = (np.float64, max(fit)) if fit else (object, 3)
        rows = np.zeros((-(-len(c) // self.fields) * self.fields, c.shape[1]), dtype=np.int64 if self.kind is np.float64 else object)
        rows[:len(c)] = c
        rows[:len(c)] += self.bias
        parts = [rows[f::self.fields] << (f * self.width) for f in range(self.fields)]
        self.wide = sum(parts[1:], parts[0]).T.astype(self.kind)

    def scores(self, a: np.ndarray) -> np.ndarray:
        """Exact inner products (anchors x candidates); beyond a long they saturate."""
        whole = object if self.kind is object else np.int64
        total = (a.astype(self.kind) @ self.wide).astype(whole)
        # Take the bias back and lift every field to be non-negative.
        lift = self.off - self.bias * a.astype(whole).sum(axis=1)
        total = total + (lift * sum(1 << (f * self.width) for f in range(self.fields)))[:, None]
        out = np.empty((len(a), total.shape[1] * self.fields), dtype=np.int64)
        for f in range(self.fields):
            field = ((total >> (f * self.width)) & ((1 << self.width) - 1)) - self.off
            out[:, f::self.fields] = saturated(field) if self.kind is object else field
        return out[:, :self.n]


def limits(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) s with low * score <= 100 * s <= high * score, in whole numbers."""
    least = [-((-low * int(s)) // 100) for s in score]
    most = [(high * int(s)) // 100 for s in score]
    return saturated(np.array(least, dtype=object)), saturated(np.array(most, dtype=object))


class Best:
    """The best candidates of one block of anchors so far.

    An anchor row is (cid, q, label, least, most): wanted are the ``keep`` highest scores from least to
    most among candidates of its own label (``same``) or of every other one.
    """

    def __init__(self, keep: int, same: bool):
        self.keep, self.same, self.held, self.a = keep, same, [], None
        self.row, self.score, self.vec = (np.empty(0, dtype=np.int64) for _ in range(3))

    def add(self, batch: pa.RecordBatch) -> None:
        cand = batch.column("cand").to_numpy(zero_copy_only=False)
        if not cand.all():  # anchors come first
            self.held.append(batch.filter(pa.array(~cand)))
        batch = batch.filter(pa.array(cand))
        if batch.num_rows and self.held and self.a is None:
            table = pa.Table.from_batches(self.held).combine_chunks()
            self.a = matrix(table.column("q").combine_chunks())
            self.cid, self.label, self.least, self.most = (table.column(c).to_numpy() for c in ("cid", "of", "least", "most"))
            self.limit, self.length = self.least.copy(), longest(self.a)
        for at in range(0, batch.num_rows if self.a is not None else 0, PIECE):
            self._piece(batch.slice(at, PIECE))

    def _piece(self, batch: pa.RecordBatch) -> None:
        packed = Fields(matrix(batch.column("q")), self.length)
        ids, label = batch.column("ids"), batch.column("of").to_numpy()
        first = ragged(ids, np.arange(len(ids)))
        first = first[0][np.flatnonzero(np.r_[True, first[1][1:] != first[1][:-1]])]  # ids are never empty
        found = []
        for at in range(0, len(self.a), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            # Anchor rows of one class follow each other and differ in their limits only.
            new = np.r_[True, self.cid[part][1:] != self.cid[part][:-1]]
            s = packed.scores(self.a[part][new])[np.cumsum(new) - 1]
            ok = (s >= self.limit[part, None]) & (s <= self.most[part, None])
            ok &= (self.label[part, None] == label[None, :]) == self.same
            row, col = np.nonzero(ok)
            best = best_first(row, s[row, col], first[col], self.keep)
            row, col = row[best], col[best]
            more, of = ragged(ids, col)
            found.append((row[of] + at, s[row, col][of], more))
        row, score, vec = (np.concatenate([old, *(f[c] for f in found)]) for c, old in enumerate((self.row, self.score, self.vec)))
        best = best_first(row, score, vec, self.keep)
        self.row, self.score, self.vec = row[best], score[best], vec[best]
        full = np.flatnonzero(np.bincount(self.row, minlength=len(self.a)) == self.keep)
        self.limit[full] = self.score[np.searchsorted(self.row, full, side="right") - 1]  # equal scores may still have smaller ids

    def result(self):
        if len(self.row):
            yield pa.RecordBatch.from_arrays([pa.array(self.cid[self.row]), pa.array(self.most[self.row]), pa.array(self.score), pa.array(self.vec)],
                                             names=["cid", "most", "score", "vec_id"])


def _meet(anchors: DataFrame, candidates: DataFrame, by: list, keep: int, same: bool, block: int) -> DataFrame:
    """(cid, most, score, vec_id): the ``keep`` best of every anchor row among the candidates that agree with it in ``by``.

    Anchors are dealt to blocks of about ``block`` and candidates to groups, within each value of ``by``;
    every block meets every group in a task of its own.
    """
    blocks = anchors.groupBy(*by).agg(F.ceil(F.count_distinct("cid") / block).cast("int").alias("blocks"))
    groups = candidates.groupBy(*by).agg(F.least(F.ceil(F.count("*") / PIECE), F.lit(4096)).cast("int").alias("groups"))

    def dealt(df: DataFrame) -> DataFrame:
        if by:
            return df.join(plan, by)
        return df.withColumns({"blocks": F.lit(plan[0]), "groups": F.lit(plan[1])})

    def own(count: str):
        return F.pmod(F.xxhash64(F.lit(7), "cid"), F.col(count)).cast("int")

    def each(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    plan = staged(blocks.join(groups, by), "plan") if by else (blocks.first()[0], groups.first()[0])
    if not by and 0 in plan:
        anchors, candidates, plan = anchors.limit(0), candidates.limit(0), (1, 1)
    keys = [*by, "block", "group"]
    zero = F.lit(0).cast("long")
    a = (dealt(anchors).withColumn("block", own("blocks")).withColumn("group", each("groups"))
         .select(*keys, F.lit(False).alias("cand"), "cid", "q", F.col("label").alias("of"), "least", "most", F.lit(None).cast("array<long>").alias("ids")))
    c = (dealt(candidates).withColumn("group", own("groups")).withColumn("block", each("blocks"))
         .select(*keys, F.lit(True), "cid", "q", F.col("label"), zero, zero, "ids"))

    def run(batches):
        state, now = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in keys]
            change = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
            cut = np.flatnonzero(np.r_[True, change, True])
            for i, j in zip(cut, cut[1:]):
                key = tuple(int(x[i]) for x in columns)
                if key != now:
                    if state is not None:
                        yield from state.result()
                    state, now = Best(keep, same), key
                state.add(batch.slice(i, j - i))
        if state is not None:
            yield from state.result()
    met = a.union(c).repartition(*keys).sortWithinPartitions(*keys, "cand", "cid")
    found = met.mapInArrow(run, "cid long, most long, score long, vec_id long")
    order = Window.partitionBy("cid", "most").orderBy(F.desc("score"), "vec_id")
    return staged(found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep).drop("r"), "best")


def mine(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         scale: int = 256, label: str = "label", block: int = 1 << 21) -> DataFrame:
    """Hard negatives for every anchor row (``is_anchor``, a condition on vec_id) and each of its positives.

    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score). A row's score is its integer
    inner product with the anchor; higher comes first, ties by smaller vec_id. Positives are the first
    ``positives`` other rows of the anchor's label; for each, the first ``negatives`` rows of other labels
    with low * positive_score <= 100 * negative_score <= high * positive_score. Fewer if there are fewer;
    an anchor without positives, or a positive without negatives, has no row. Rows with a null id, label
    or vector, or with null or non-finite components take no part. Repeated rows count once, an id
    with several rows is several candidates but never its own positive. Other columns are not read.
    ``block`` is the number of components of the anchors that one task holds.
    """
    rows = quantised(vectors.withColumn("label", F.col(label).cast("long")), scale, ("label",))
    rows = staged(rows, "integers")
    classes = staged(integer_classes(rows, ["label", "q"], max(positives + 1, negatives)), "classes")
    asked = staged(rows.where(is_anchor).join(classes.select("cid", "label", "q"), ["label", "q"]).select("vec_id", "cid"), "anchors")
    width = classes.agg(F.max(F.size("q"))).first()[0] or 1
    block = max(1, block // width)
    anchors = classes.join(asked.select("cid").distinct(), "cid", "left_semi").select("cid", "q", "label")
    free = anchors.withColumns({"least": F.lit(LOW), "most": F.lit((1 << 63) - 1)})
    near = _meet(free, classes, ["label"], positives + 1, True, block)
    best = near.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct(F.bitwise_not("score").alias("low"), "vec_id", "score"))).alias("best"))
    others = F.expr(f"slice(filter(best, x -> x.vec_id != anchor_id), 1, {positives})")
    pairs = asked.withColumnRenamed("vec_id", "anchor_id").join(best, "cid").select("anchor_id", "cid", F.explode(others).alias("b"))
    pairs = staged(pairs.select("anchor_id", "cid", F.col("b.vec_id").alias("positive_id"), F.col("b.score").alias("positive_score")), "positives")

    wanted = pairs.select("cid", "positive_score").distinct()
    wanted = wanted.mapInArrow(_limits(low, high), "cid long, positive_score long, least long, most long").where("least <= most")
    wanted = staged(wanted, "wanted")
    bounded = anchors.join(wanted, "cid").select("cid", "q", "label", "least", "most").distinct()
    far = _meet(bounded, classes, [], negatives, False, block)
    order = Window.partitionBy("cid", "most").orderBy(F.desc("score"), "vec_id")
    far = far.withColumn("rank", F.row_number().over(order))
    return (pairs.join(wanted, ["cid", "positive_score"]).join(far, ["cid", "most"])
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))


def _limits(low: int, high: int):
    def run(batches):
        for batch in batches:
            least, most = limits(batch.column(1).to_numpy(), low, high)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least), pa.array(most)], names=["cid", "positive_score", "least", "most"])
    return run
