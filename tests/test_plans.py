"""Plan-shape guards for every registered query (scale properties, not values)."""

import re

import pytest

import __spark_entry__ as entry_mod
from conftest import SF001, plan_text
from scoreline.plans import QUERIES

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas", "MapInArrow"]


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_cross_joins_no_python(spark, key):
    plan = plan_text(entry_mod.queries()[key](spark, SF001))
    for op in FORBIDDEN:
        assert op not in plan, f"{key}: {op} in plan"


@pytest.mark.parametrize("key", ["season_standings", "gap_to_leader"])
def test_top_n_per_group_is_a_group_limit(spark, key):
    assert "WindowGroupLimit" in plan_text(entry_mod.queries()[key](spark, SF001))


def test_scans_are_pruned_and_filtered(spark):
    plan = plan_text(entry_mod.queries()["biggest_margins"](spark, SF001))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("date" in s or "team" in s or "name" in s or "n_" in s for s in schemas)
    # the stored match table is read with only the columns the report uses
    match_scan = [s for s in schemas if "home_team_goal" in s][0]
    assert "country_id" not in match_scan
    derived = plan_text(entry_mod.queries()["check_unique"](spark, SF001))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in derived


def test_fixed_size_dimensions_are_broadcast(spark):
    plan = plan_text(entry_mod.queries()["group_overview"](spark, SF001))
    assert plan.count("BroadcastExchange") >= 2 and "SortMergeJoin" not in plan


def test_exclusions_prune_before_the_window(spark):
    # The excluded season is a partition key of the rank window, so the filter
    # legally moves below it, down to the stored table's season partitions.
    plan = plan_text(entry_mod.queries()["gap_to_leader"](spark, SF001))
    assert "PartitionFilters: [isnotnull(season" in plan or "NOT (season" in plan
    assert re.search(r"PartitionFilters: \[[^\]]*NOT \(season#\d+ = 2001\)", plan)
    assert "Not(EqualTo(n_name,NATION_24))" in plan


def test_head_to_head_filters_the_matches_before_any_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan_text(entry_mod.queries()["head_to_head"](spark, SF001), "simple").split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # One filter holds both id conditions, below every exchange of the matches.
    both = [i for i, line in enumerate(lines) if re.search(r"Filter .*array_contains.*array_contains", line)]
    assert both and "home_team_api_id" in lines[both[0]] and "away_team_api_id" in lines[both[0]], lines
    moved = [i for i, line in enumerate(lines) if re.search(r"Exchange hashpartitioning\((home|away)_team_api_id", line)]
    assert moved and max(moved) < both[0], lines


def test_integrity_checks_shuffle_once_per_key_type(spark):
    # Without the scalar subqueries (a parent's row and NULL counts), which run once each.
    report = plan_text(entry_mod.queries()["integrity_report"](spark, SF001)).split("===== Subqueries")[0]
    assert len(re.findall(r"^\(\d+\) Exchange\b", report, re.M)) < 10
    fks = plan_text(entry_mod.queries()["check_fk"](spark, SF001))
    assert len(re.findall(r"^\(\d+\) Exchange\b", fks, re.M)) == 1 and "Join" not in fks
