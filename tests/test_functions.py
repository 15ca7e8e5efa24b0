from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import plan_text
from scoreline.functions import half_up, in_run, pct, points, result


def exact(n: int, d: int, digits: int) -> float:
    q = (Decimal(n) / Decimal(d)).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP)
    return float(q)


def test_half_up_grid_matches_decimal_rounding(spark):
    pairs = [(n, d) for d in range(1, 41) for n in range(-2 * d, 2 * d + 1)]
    df = spark.createDataFrame(pairs, "n long, d long")
    got = df.select("n", "d", half_up("n", "d", 1).alias("r1"), half_up("n", "d", 2).alias("r2"),
                    pct("n", "d").alias("p")).collect()
    for row in got:
        assert row.r1 == exact(row.n, row.d, 1)
        assert row.r2 == exact(row.n, row.d, 2)
        assert row.p == exact(100 * row.n, row.d, 1)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(1, 10**6)), min_size=1, max_size=30))
def test_half_up_property(spark, pairs):
    df = spark.createDataFrame(pairs, "n long, d long")
    for row in df.select("n", "d", half_up("n", "d", 2).alias("r")).collect():
        assert row.r == exact(row.n, row.d, 2)


def test_half_up_zero_or_null_denominator_is_null(spark):
    df = spark.createDataFrame([(1, 0), (1, None), (None, 3)], "n long, d long")
    assert [r.r for r in df.select(half_up("n", "d", 1).alias("r")).collect()] == [None, None, None]


def test_outcome_null_policies(spark):
    df = spark.createDataFrame([(2, 1), (1, 1), (0, 1), (None, 1)], "gf int, ga int")
    rows = df.select(result("gf", "ga", "draw").alias("as_draw"), result("gf", "ga", "loss").alias("as_loss"),
                     points("gf", "ga").alias("pts"), in_run("gf", "ga", "win").alias("w"),
                     in_run("gf", "ga", "unbeaten").alias("u")).collect()
    assert [r.as_draw for r in rows] == ["W", "D", "L", "D"]
    assert [r.as_loss for r in rows] == ["W", "D", "L", "L"]
    assert [r.pts for r in rows] == [3, 1, 0, 0]
    assert [r.w for r in rows] == [True, False, False, False]
    assert [r.u for r in rows] == [True, True, False, False]


def test_pct_stays_in_codegen(spark):
    df = spark.range(10).select(pct(F.col("id"), F.lit(7)).alias("p"))
    plan = plan_text(df)
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_sized_conf_scales_with_input():
    from scoreline.session import sized_conf
    small, big = sized_conf(10 << 20), sized_conf(100 * (1 << 40))
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * (1 << 40) // (256 << 20) + 1
    assert big["spark.sql.files.maxPartitionBytes"] == str(256 << 20)


@pytest.mark.parametrize("n", [150_000_000, 10**10])
def test_rate_gap_is_exact_beyond_64_bits(spark, n):
    from decimal import ROUND_HALF_UP, Decimal

    from scoreline.functions.rounding import half_up_wide
    hm, hw, am, aw = n, n // 3 + 7, n - 11, n // 5
    d = lambda x: F.lit(x).cast("decimal(19,0)")
    gap = half_up_wide(F.lit(100).cast("decimal(3,0)") * (d(hw) * d(am) - d(aw) * d(hm)), d(hm) * d(am), 1)
    got = spark.range(1).select(gap.alias("g")).first().g
    want = Decimal(100 * (hw * am - aw * hm)) / Decimal(hm * am)
    assert got == float(want.quantize(Decimal("0.1"), ROUND_HALF_UP))
