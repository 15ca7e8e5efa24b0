"""Scans over chunks equal single windows: sums, ranks, neighbours and RANGE frames, for hot groups and any order type."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import plan_text
from scoreline.operators import scan


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        g = 0 if i % 3 == 0 else rnd.randint(1, 40)          # group 0 holds a third
        rows.append((i, g, rnd.randint(1, 50), rnd.choice([0, 1, 1, 3]), rnd.choice([None, 1, 2, 2, 5])))
    rows.append((3000, None, 1, 1, 2))                          # a NULL group
    rows += [(3001, 0, None, 2, 1), (3002, 0, None, 1, None), (None, 0, 7, 1, 2)]  # NULL order keys
    return spark.createDataFrame(rows, "id long, g long, day int, v int, score int")


def _same(a, b, cols):
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0
    assert a.count() == b.count()


CHUNKED = {"rows": 40}  # the hot group falls into some 25 chunks


@pytest.mark.parametrize("nulls_last", [False, True])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("rows", [40, None])
def test_running_sums_match_windows(skewed, nulls_last, descending, rows):
    df = skewed.withColumn("one", F.lit(1))
    a = scan.running_sums(df, ["g"], ["day", "id"], {"run": "v", "place": "one"}, nulls_last=nulls_last, descending=descending, rows=rows)
    order = scan._order(["day", "id"], nulls_last, descending)
    w = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    _same(a, df.withColumn("run", F.sum("v").over(w)).withColumn("place", F.sum("one").over(w)), ["id", "g", "run", "place"])
    assert a.columns == [*df.columns, "run", "place"]
    assert scan.running_sum(skewed.limit(0), ["g"], ["day", "id"], "v", "run").count() == 0


def test_hot_group_is_cut_into_chunks(spark):
    """A group whose order key is a timestamp, distinct in every row, or whose rows share a day, covers many chunks."""
    df = spark.range(4000).selectExpr("0L AS g", "timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, 0, id) AS at", "1L AS v",
                                      "cast(id AS string) AS id", "date'2020-01-01' AS day")
    for order in (["at", "id"], ["day", "id"]):
        sizes = [r["count"] for r in scan.chunked(df, ["g"], order, rows=250).groupBy("_chunk").count().collect()]
        assert len(sizes) == 16 and max(sizes) < 400 and sum(sizes) == 4000
    got = scan.running_sum(df, ["g"], ["at", "id"], "v", "run", rows=250)
    assert [r.run for r in got.orderBy("at").collect()] == list(range(1, 4001))


def test_borders_come_from_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(scan, "SAMPLE", 300)
    df = spark.range(6000).selectExpr("id % 3 div 2 AS g", "id", "1L AS v")
    chunks = scan.chunked(df, ["g"], ["id"], rows=500)
    sizes = [r["count"] for r in chunks.groupBy("g", "_chunk").count().collect()]
    assert 6 <= len(sizes) <= 18 and max(sizes) < 1500
    a = scan.running_sum(df, ["g"], ["id"], "v", "run", rows=500)
    w = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    _same(a, df.withColumn("run", F.sum("v").over(w)), ["id", "g", "run"])


@pytest.mark.parametrize("nulls_last", [False, True])
@pytest.mark.parametrize("rows", [7, 40, None])
def test_neighbours_match_lag_and_lead(skewed, nulls_last, rows):
    a = scan.neighbours(skewed, ["g"], ["day", "id"], ["id", "score"], nulls_last=nulls_last, rows=rows)
    w = Window.partitionBy("g").orderBy(*scan._order(["day", "id"], nulls_last, False))
    b = skewed.select("*", *[f(c).over(w).alias(f"{n}_{c}") for n, f in (("prev", F.lag), ("next", F.lead)) for c in ("id", "score")])
    _same(a, b, ["id", "g", "prev_id", "prev_score", "next_id", "next_score"])
    assert scan.neighbours(skewed.limit(0), ["g"], ["day", "id"], ["id"]).count() == 0


@pytest.mark.parametrize("before,after", [(0, 0), (3, 0), (10, 4), (1000, 0)])
@pytest.mark.parametrize("rows", [40, None])
def test_range_sums_match_range_frames(skewed, before, after, rows):
    df = skewed.withColumn("one", F.lit(1))
    a = scan.range_sums(df, ["g"], "day", {"s": "score", "n": "one"}, before, after, rows=rows)
    w = Window.partitionBy("g").orderBy("day").rangeBetween(-before, after)
    _same(a, df.withColumn("s", F.sum("score").over(w)).withColumn("n", F.sum("one").over(w)), ["id", "g", "day", "s", "n"])


def test_range_sums_of_a_single_hot_day(spark):
    """One day of one team holds all rows: many chunks, every row sees all of them."""
    df = spark.range(2000).selectExpr("1 AS g", "5 AS day", "id", "id % 7 AS v")
    a = scan.range_sums(df, ["g"], "day", {"s": "v"}, 60, rows=100)
    assert {r.s for r in a.select("s").distinct().collect()} == {sum(i % 7 for i in range(2000))} and a.count() == 2000
    assert scan.range_sums(df.limit(0), ["g"], "day", {"s": "v"}, 60).count() == 0


def test_no_window_spans_a_group(spark, skewed):
    """Windows over rows are partitioned by (group, chunk); what is windowed per group is one row a chunk."""
    for df in (scan.running_sum(skewed, ["g"], ["day", "id"], "v", "run"), scan.neighbours(skewed, ["g"], ["day", "id"], ["id"]),
               scan.range_sums(skewed, ["g"], "day", {"s": "v"}, 5)):
        plan = plan_text(df, "simple")
        whole = [x for x in plan.split("\n") if "windowspecdefinition(" in x and "_chunk" not in x]
        assert whole and all("_g0" in x for x in whole)
        rows = [x for x in plan.split("\n") if "Exchange hashpartitioning(" in x and "_chunk" in x and "_g0" not in x]
        assert rows and "SortMergeJoin" not in plan


@pytest.mark.parametrize("kind", ["int", "double", "string"])
def test_rank_matches_window_with_nulls_and_ties(skewed, kind):
    df = skewed.withColumn("score", F.col("score").cast(kind))
    a = scan.rank_desc(df, ["g"], "score", "r", rows=2)
    w = Window.partitionBy("g").orderBy(F.col("score").desc_nulls_first())
    _same(a, df.withColumn("r", F.rank().over(w).cast("long")), ["id", "g", "r"])


def test_result_does_not_depend_on_partition_count(spark, skewed):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = scan.running_sum(skewed, ["g"], ["day", "id"], "v", "run")
            out.append(sorted(((r.id is None, r.id or 0), r.run) for r in df.collect()))
        assert out[0] == out[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
