"""Dated snapshots of entities: latest per period, pivoted comparison, yearly evolution.

"Latest snapshot per (entity, period)" is an aggregate here, not a window:
``max_by(values, (ts, id))`` per (entity, period). It combines map-side,
so an entity with millions of snapshots in one period costs one partial row
per map task; a ``row_number() = 1`` window would sort them all in one task.
The id makes the order total, so ties on the timestamp are resolved the
same way every run.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scoreline.functions import sql_asc
from scoreline.functions.rounding import half_up


def _period(ts: Column, period: str) -> Column:
    if period == "year":
        return F.year(ts).cast("long")
    if period == "month":
        return F.date_trunc("month", ts).cast("date")
    if period == "day":
        return ts.cast("date")
    raise ValueError(f"period must be 'year', 'month' or 'day', not {period!r}")


def _as_timestamp(snapshots: DataFrame, ts: str) -> Column:
    # Text dates are cast strictly: malformed text raises (ANSI cast).
    if isinstance(snapshots.schema[ts].dataType, StringType):
        return F.col(ts).cast("timestamp_ntz")
    return F.col(ts)


def latest_per_period(snapshots: DataFrame, entity: str, ts: str, order_id: str,
                      values: Sequence[str], period: str = "year") -> DataFrame:
    """One row per (entity, period) with ``values`` of the latest snapshot.

    Latest = greatest (timestamp, ``order_id``). ``ts`` may be text (cast
    to a timestamp) or a timestamp. Output: entity, period, *values.
    """
    t = _as_timestamp(snapshots, ts)
    return (snapshots
            .select(entity, _period(t, period).alias("period"),
                    F.struct(*values).alias("_v"), F.struct(t.alias("_ts"), F.col(order_id)).alias("_o"))
            .groupBy(entity, "period")
            .agg(F.max_by("_v", "_o").alias("_v"))
            .select(entity, "period", *[F.col(f"_v.{v}").alias(v) for v in values]))


def _any_ilike(col: Column, patterns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [col.ilike(p) for p in patterns])


def compare_latest(entities: DataFrame, snapshots: DataFrame, *, key: str, name: str,
                   ts: str, order_id: str, metric: str, select: Sequence[str],
                   columns: Sequence[tuple[str, str]], period: str = "year") -> DataFrame:
    """Latest ``metric`` per period for a few entities, side by side, and their difference.

    Entities whose ``name`` matches any ``select`` pattern (ILIKE) are kept;
    their snapshots are reduced to the latest per (entity, period); each
    output column ``(label, pattern)`` takes the metric of the entity whose
    name matches ``pattern`` (MAX over matches); ``difference`` is the first
    column minus the second, NULL when either side is missing.
    """
    chosen = entities.filter(_any_ilike(F.col(name), select)).select(key, name)
    # Reduced on the scan's side first: a hot entity is one row per period and map task in the shuffle.
    latest = latest_per_period(snapshots, key, ts, order_id, [metric], period)
    named = latest.join(chosen, on=key)
    pivots = [F.max(F.when(F.col(name).ilike(p), F.col(metric))).alias(label)
              for label, p in columns]
    out = named.groupBy("period").agg(*pivots)
    if len(columns) >= 2:
        out = out.withColumn("difference", F.col(columns[0][0]) - F.col(columns[1][0]))
    return out.orderBy(*sql_asc("period"))


def yearly_evolution(entities: DataFrame, snapshots: DataFrame, *, key: str, name: str,
                     ts: str, order_id: str, metrics: Sequence[str],
                     passthrough: Sequence[str] = (), only: Iterable[str] | None = None,
                     name_as: str = "name", digits: int = 1,
                     abrupt: dict[str, int] | None = None) -> DataFrame:
    """Per entity and year: each metric, its previous available value, the change,
    and the entity's mean over all its years (rounded half up); plus pass-through columns.

    "Previous" is the previous *available* year of that entity, not the
    calendar year before. ``only`` restricts to entities with those names
    (applied before the windows: it is a filter on the window's partition key).
    ``abrupt`` = {metric: n} keeps only years where some listed metric moved
    by at least n (absolute change), applied after the windows.
    """
    chosen = entities.select(key, F.col(name).alias(name_as))
    if only is not None:
        chosen = chosen.filter(F.col(name_as).isin(list(only)))
    # Reduced first, then joined once; an inner join drops entities without a row or not asked for.
    yearly = latest_per_period(snapshots, key, ts, order_id, list(metrics) + list(passthrough), "year") \
        .withColumnRenamed("period", "year").join(chosen, on=key)
    by_year = Window.partitionBy(key).orderBy("year")
    whole = Window.partitionBy(key)
    # All window calls in one projection: one Window node per distinct spec
    # (previous year; whole history), both on the same partitioning.
    yearly = yearly.select(
        "*",
        *[F.lag(m).over(by_year).alias(f"prev_{m}") for m in metrics],
        *[F.sum(m).over(whole).alias(f"_sum_{m}") for m in metrics],
        *[F.count(m).over(whole).alias(f"_cnt_{m}") for m in metrics])
    cols = [name_as, "year"]
    for m in metrics:
        yearly = (yearly.withColumn(f"delta_{m}", F.col(m) - F.col(f"prev_{m}"))
                  .withColumn(f"mean_{m}", half_up(f"_sum_{m}", f"_cnt_{m}", digits)))
        cols += [m, f"prev_{m}", f"delta_{m}", f"mean_{m}"]
    cols += list(passthrough)
    if abrupt:
        yearly = yearly.filter(reduce(lambda a, b: a | b,
                                      [F.abs(F.col(f"delta_{m}")) >= n for m, n in abrupt.items()]))
    return yearly.select(*cols).orderBy(*sql_asc(name_as, "year"))
