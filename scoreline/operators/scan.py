"""Ordered scans whose groups may be larger than any task: one plan for all sizes.

``SUM(x) OVER (PARTITION BY p ORDER BY o)``, ``RANK``, ``LAG`` / ``LEAD`` and RANGE frames make
Spark sort each whole group in one task. Here a group is cut into chunks along its order, and a
window never spans more than one chunk:

* Borders are chosen from a written sample of bounded size (``SAMPLE`` rows; a retried
  task and every reader of the plan see the same ones): a group gets one chunk per ``ROWS`` rows, at most
  ``CHUNKS``. A group of a third of all rows has many chunks, whatever its order columns are.
* Rows learn their chunk from a broadcast of those borders (their number is bounded by the sample) and are
  exchanged once, on (group, chunk).
* What a chunk needs from the others is one row per chunk: its total (``running_sums``) or its first and
  last row (``neighbours``). Those tables are as bounded as the borders and are broadcast too.

``range_sums`` turns a value-range frame into running sums: each row adds its values where it enters the
frames of others and takes them back where it leaves, so a frame may hold any number of rows. ``rank_desc``
collapses rows to a histogram (group, value, count) first; the rank is 1 + the running count of greater values.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from scoreline.session import checkpoint_dir

ROWS = 1 << 20    # rows a chunk aims at
CHUNKS = 1 << 10  # most chunks of one group
SAMPLE = 1 << 16  # rows that borders are chosen from


def written(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` written once as Parquet to the shared folder and read back, and its number of rows, counted meanwhile."""
    spark, seen = df.sparkSession, Observation()
    path = f"{checkpoint_dir(spark).rstrip('/')}/scoreline/scan-{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"] or 0


def _same(pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs], F.lit(True))


def _order(order_by: list[str], nulls_last: bool, descending: bool) -> list[Column]:
    if descending:
        return [F.col(c).desc_nulls_first() for c in order_by]
    return [F.col(c).asc_nulls_last() if nulls_last else F.col(c).asc_nulls_first() for c in order_by]


def _key(order_by: list[str], nulls_high: bool) -> Column:
    """The order columns as one comparable value; NULLs are the smallest, or the greatest with ``nulls_high``."""
    fields = [c for name in order_by for c in ([F.col(name).isNull(), F.col(name)] if nulls_high else [F.col(name)])]
    return F.struct(*[f.alias(f"o{i}") for i, f in enumerate(fields)])


def _borders(df: DataFrame, partition_by: list[str], key: Column, rows: int, total: int | None) -> DataFrame:
    """(_p0.., _borders, _heads, _step) of the groups with more than one chunk; ``_heads`` is every ``_step``-th border.

    The sample is written, so the borders are the same whenever they are computed from it. Where all rows
    fit one chunk there is nothing to sample.
    """
    total = df.count() if total is None else total
    groups = [f"_p{i}" for i in range(len(partition_by))]
    fraction = min(1.0, SAMPLE / max(total, 1))
    seen = df.select(*[F.col(c).alias(g) for c, g in zip(partition_by, groups)], key.alias("_k"))
    if total <= rows:
        seen = df.sparkSession.createDataFrame([], seen.schema)
    else:
        seen, _ = written(seen.sample(fraction, seed=11) if fraction < 1 else seen)
    lists = seen.groupBy(*groups).agg(F.sort_array(F.collect_list("_k")).alias("_seen"))  # SAMPLE rows in all
    n = F.least(F.lit(CHUNKS), F.size("_seen"), F.ceil(F.size("_seen") / F.lit(fraction * rows)).cast("int"))
    cut = F.transform(F.sequence(F.lit(1), F.col("_n") - 1),
                      lambda i: F.element_at("_seen", F.call_function("div", i.cast("long") * F.size("_seen"), F.col("_n")).cast("int") + 1))
    lists = lists.withColumn("_n", n).where("_n > 1").select(*groups, F.array_distinct(cut).alias("_borders"))
    lists = lists.withColumn("_step", F.ceil(F.sqrt(F.size("_borders"))).cast("int"))
    return lists.withColumn("_heads", F.filter("_borders", lambda _, i: i % F.col("_step") == 0))


def chunked(df: DataFrame, partition_by: list[str], order_by: list[str], *, nulls_last: bool = False,
            descending: bool = False, rows: int | None = None, total: int | None = None) -> DataFrame:
    """``df`` with ``_chunk``, ascending along the order, and ``_split``: the group has more than one.

    Rows that agree in all order columns lie in one chunk. The borders are fixed while the query is built.
    ``total`` is the number of rows, if it is known; otherwise they are counted.
    """
    key = _key(order_by, nulls_last or descending)
    borders = F.broadcast(_borders(df, partition_by, key, rows or ROWS, total))
    # Two short searches: the last head that is not above the key, then the borders from there.
    at = F.size(F.filter("_heads", lambda h: h <= F.col("_line_key")))
    inner = F.slice("_borders", (F.col("_head_no") - 1) * F.col("_step") + 1, F.col("_step"))
    found = (F.col("_head_no") - 1) * F.col("_step") + F.size(F.filter(inner, lambda b: b <= F.col("_line_key")))
    split = F.col("_borders").isNotNull()
    return (df.withColumn("_line_key", key)
            .join(borders, _same([(c, f"_p{i}") for i, c in enumerate(partition_by)]), "left")
            .withColumn("_head_no", F.when(split, at).otherwise(F.lit(0)))
            .withColumn("_chunk", F.when(F.col("_head_no") > 0, found).otherwise(F.lit(0)))
            .withColumn("_split", split)
            .drop("_head_no", "_line_key", "_borders", "_heads", "_step", *[f"_p{i}" for i in range(len(partition_by))]))


def _edge_names(partition_by: list[str]) -> list[str]:
    return [f"_g{i}" for i in range(len(partition_by))]


def running_sums(df: DataFrame, partition_by: list[str], order_by: list[str], values: dict[str, str], *,
                 nulls_last: bool = False, descending: bool = False, rows: int | None = None, total: int | None = None) -> DataFrame:
    """Add each ``out`` of ``values`` = {out: column}: the running total of a column (non-NULL) per group, in order.

    ``order_by`` are columns of any orderable type that order a group's rows
    totally (of rows that tie in all of them, any may come first, and they share a chunk): ascending,
    NULLs first, or last with ``nulls_last``; ``descending`` reverses it, NULLs
    first. An empty table gives no rows.
    """
    t = chunked(df, partition_by, order_by, nulls_last=nulls_last, descending=descending, rows=rows, total=total)
    groups = _edge_names(partition_by)
    way = F.col("_c").desc() if descending else F.col("_c").asc()
    before = Window.partitionBy(*groups).orderBy(way).rowsBetween(Window.unboundedPreceding, -1)
    totals = (t.where("_split").groupBy(*partition_by, "_chunk").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(values.values())])
              .select(*[F.col(c).alias(g) for c, g in zip(partition_by, groups)], F.col("_chunk").alias("_c"),
                      *[F.col(f"_t{i}") for i in range(len(values))]))
    totals = totals.select(*groups, "_c", *[F.sum(f"_t{i}").over(before).alias(f"_s{i}") for i in range(len(values))])
    inside = (Window.partitionBy(*partition_by, "_chunk").orderBy(*_order(order_by, nulls_last, descending))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = t.select("*", *[F.sum(c).over(inside).alias(f"_i{i}") for i, c in enumerate(values.values())])
    on = _same([*zip(partition_by, groups), ("_chunk", "_c")])
    helpers = [*groups, "_c", "_chunk", "_split", *[f"_{k}{i}" for i in range(len(values)) for k in "is"]]
    return (out.join(F.broadcast(totals), on, "left")
            .withColumns({name: F.col(f"_i{i}") + F.coalesce(F.col(f"_s{i}"), F.lit(0)) for i, name in enumerate(values)})
            .drop(*helpers))


def running_sum(df: DataFrame, partition_by: list[str], order_by: list[str], value: str, out: str, **options) -> DataFrame:
    """``running_sums`` of a single column."""
    return running_sums(df, partition_by, order_by, {out: value}, **options)


def neighbours(df: DataFrame, partition_by: list[str], order_by: list[str], columns: list[str], *,
               nulls_last: bool = False, rows: int | None = None) -> DataFrame:
    """Add ``prev_<c>`` and ``next_<c>`` = LAG(c) and LEAD(c) per group, in order, for every listed column.

    The order is that of ``running_sums``. The first row of a chunk finds its predecessor in the last row of
    the chunk before, the last row its successor in the first row of the next: one row per chunk is carried.
    """
    t = chunked(df, partition_by, order_by, nulls_last=nulls_last, rows=rows)
    groups = _edge_names(partition_by)
    carried = F.struct(*columns)
    key = _key(order_by, nulls_last)
    edges = (t.where("_split").groupBy(*partition_by, "_chunk").agg(F.min_by(carried, key).alias("_first"), F.max_by(carried, key).alias("_last"))
             .select(*[F.col(c).alias(g) for c, g in zip(partition_by, groups)], F.col("_chunk").alias("_c"), "_first", "_last"))
    along = Window.partitionBy(*groups).orderBy("_c")
    edges = edges.select(*groups, "_c", F.lag("_last").over(along).alias("_before"), F.lead("_first").over(along).alias("_after"))
    inside = Window.partitionBy(*partition_by, "_chunk").orderBy(*_order(order_by, nulls_last, False))
    out = t.select("*", F.lag(carried).over(inside).alias("_lag"), F.lead(carried).over(inside).alias("_lead"))
    out = out.join(F.broadcast(edges), _same([*zip(partition_by, groups), ("_chunk", "_c")]), "left")
    prev, next_ = F.coalesce("_lag", "_before"), F.coalesce("_lead", "_after")
    return (out.withColumns({f"prev_{c}": prev.getField(c) for c in columns} | {f"next_{c}": next_.getField(c) for c in columns})
            .drop(*groups, "_c", "_chunk", "_split", "_before", "_after", "_lag", "_lead"))


def range_sums(df: DataFrame, partition_by: list[str], position: str, values: dict[str, str], preceding: int,
               following: int = 0, *, rows: int | None = None) -> DataFrame:
    """Add each ``out`` of ``values`` = {out: column}: SUM(column) OVER (PARTITION BY .. ORDER BY position RANGE
    BETWEEN preceding PRECEDING AND following FOLLOWING).

    ``position`` and the summed columns are whole numbers (a day number, say). As in SQL a sum is NULL if the
    frame holds no value, rows of one position are peers, and those without a position are peers
    of each other alone. The frame's size does not matter: a row becomes three marks on the line (its values
    enter at position - following, it asks at its position, its values leave after position + preceding), and
    a running sum over the marks answers all. Rows equal in every column share a chunk.
    """
    names = df.columns
    missing = F.col(position).isNull()
    here = F.coalesce(F.col(position).cast("long"), F.lit(0).cast("long"))
    row = F.struct(*names)
    nothing = F.lit(None).cast(df.select(row.alias("r")).schema["r"].dataType)
    zero = F.lit(0).cast("long")

    def mark(at: Column, step: int, sign: int) -> Column:
        held = [c for v in values.values() for c in (F.coalesce(F.col(v).cast("long"), zero), F.col(v).isNotNull().cast("long"))]
        return F.struct(at.alias("_at"), F.lit(step).alias("_step_"), (row if not sign else nothing).alias("_row"),
                        *[(h * sign).alias(f"_v{i}") for i, h in enumerate(held)])

    marks = F.array(mark(here - following, 0, 1), mark(here, 1, 0), mark(here + preceding, 2, -1))
    # The tie divides the marks of one position, which a third of the rows may share.
    line = (df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(partition_by)], missing.alias("_missing"),
                      F.xxhash64(*names).alias("_tie"), F.inline(marks)))
    groups = [*[f"_k{i}" for i in range(len(partition_by))], "_missing"]
    sums = running_sums(line, groups, ["_at", "_step_", "_tie"], {f"_r{i}": f"_v{i}" for i in range(2 * len(values))}, rows=rows)
    found = [F.when(F.col(f"_r{2 * i + 1}") > 0, F.col(f"_r{2 * i}")).alias(name) for i, name in enumerate(values)]
    return sums.where("_step_ = 1").select("_row.*", *found)


def rank_desc(df: DataFrame, partition_by: list[str], value: str, out: str, *, rows: int | None = None) -> DataFrame:
    """Add ``out`` = RANK() OVER (PARTITION BY partition_by ORDER BY value DESC NULLS FIRST).

    ``df`` is read twice; pass a written table if it is dear to compute.
    """
    keys = [*partition_by, value]
    counts, total = written(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    places = running_sum(counts, partition_by, [value], "_n", "_upto", descending=True, rows=rows, total=total)
    places = places.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)],
                           (F.col("_upto") - F.col("_n") + 1).cast("long").alias(out))
    return df.join(places, _same([(c, f"_k{i}") for i, c in enumerate(keys)])) \
        .drop(*[f"_k{i}" for i in range(len(keys))])
