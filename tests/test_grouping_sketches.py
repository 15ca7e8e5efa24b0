"""Grouping sets, distinct-count sketches and collated names."""

import pytest
from pyspark.sql import functions as F

from conftest import SF01, plan_text
from scoreline import operators as op
from scoreline.operators import sketches
from scoreline.sources import match_tables

TEAMS, LEAGUES = {1: "A", 2: "B", 3: "C"}, {10: "North", 20: "South"}
ROWS = [(1, 10, "2020", 1, "2020-01-01", 1, 2, 2, 0), (2, 10, "2020", 2, "2020-02-01", 2, 1, 1, 1),
        (3, 20, "2021", 1, "2021-01-01", 2, 1, 3, 0), (4, 10, "2021", 2, "2021-02-01", 1, 2, None, None),
        (5, 10, "2021", 3, "2021-03-01", 1, 3, 9, 0)]


def test_detail_and_balance_in_one_result(fx):
    m, t = fx.matches(ROWS), fx.teams(TEAMS)
    rows = [tuple(r) for r in op.head_to_head_report(m, t, "A", "B", ("at A", "at B")).collect()]
    assert [r[0] for r in rows] == ["match"] * 4 + ["season"] * 2 + ["venue"] * 2 + ["all"]
    detail = [(r[1], r[2], r[5], r[6], r[7]) for r in rows[:4]]
    assert detail == [("2020", "at A", "A 2-0 B", "A", 1), ("2020", "at B", "B 1-1 A", "Draw", 1),
                      ("2021", "at B", "B 3-0 A", "B", 1), ("2021", "at A", None, "Draw", 1)]
    # meetings, wins of A, of B, draws, goals of A, of B
    assert [(r[1], r[2], r[7:]) for r in rows[4:]] == [
        ("2020", None, (2, 1, 0, 1, 3, 1)), ("2021", None, (2, 0, 1, 1, 0, 3)), (None, "at A", (2, 1, 0, 1, 2, 0)),
        (None, "at B", (2, 0, 1, 1, 1, 4)), (None, None, (4, 1, 1, 2, 3, 4))]
    summary = op.head_to_head_summary(m, t, "A", "B").first()
    assert rows[-1][7:11] == (summary.meetings, summary.wins_a, summary.wins_b, summary.draws)
    assert op.head_to_head_report(m, t, "A", "nobody").count() == 0
    plan = plan_text(op.head_to_head_report(m, t, "A", "B"), "simple")
    assert plan.count(" Expand ") == 1 and "Union" not in plan  # one pass


def test_overview_rollup_adds_up(spark, fx):
    m, lg, ct = fx.matches(ROWS), fx.leagues(LEAGUES), fx.countries({0: "Land"})
    rows = {(r.level, r.country, r.league): r for r in op.overview_rollup(m, lg, ct).collect()}
    assert set(rows) == {("league", "Land", "North"), ("league", "Land", "South"), ("country", "Land", None), ("all", None, None)}
    north, whole = rows["league", "Land", "North"], rows["all", None, None]
    assert (north.matches, north.teams, north.total_goals, north.goals_per_match, north.pct_draws) == (4, 2, 13, 4.33, 25.0)
    assert (whole.matches, whole.teams, whole.total_goals) == (5, 2, 16)  # a home team of both leagues counts once
    # The league level is the plain report.
    mt = match_tables(spark, SF01)
    plain = op.group_overview(mt.matches, mt.leagues, mt.countries)
    level = op.overview_rollup(mt.matches, mt.leagues, mt.countries).where("level = 'league'").select(*plain.columns)
    assert level.exceptAll(plain).count() == 0 and level.count() == plain.count()


def _many(spark, lo, hi, league="1L", season="'2020'"):
    return spark.range(lo, hi).selectExpr(f"{league} AS league_id", f"{season} AS season", "id AS home_team_api_id")


def test_merged_sketches_keep_their_error_bound(spark):
    parts = [_many(spark, 0, 60_000), _many(spark, 30_000, 90_000, season="'2021'"), _many(spark, 80_000, 140_000, league="2L")]
    stored = [op.team_sketches(p) for p in parts]
    whole = op.merge_sketches(stored, by=[])
    n, est = whole.select("matches", F.hll_sketch_estimate("teams")).first()
    assert n == 180_000 and abs(est - 140_000) <= 4 * sketches.standard_error() * 140_000
    per_league = {r.league_id: r.e for r in op.merge_sketches(stored, by=["league_id"]).select("league_id", F.hll_sketch_estimate("teams").alias("e")).collect()}
    assert abs(per_league[1] - 90_000) <= 4 * sketches.standard_error() * 90_000
    # Merging in new matches of a season equals sketching all of them at once.
    once = op.team_sketches(parts[0].unionByName(_many(spark, 50_000, 70_000)))
    merged = op.merge_sketches([stored[0], op.team_sketches(_many(spark, 50_000, 70_000))])
    value = lambda df: df.select("league_id", "season", "matches", F.hll_sketch_estimate("teams")).first()
    assert value(once) == value(merged)
    for p in (4, 8, 16):
        e = op.team_sketches(parts[0], p).select(F.hll_sketch_estimate("teams")).first()[0]
        assert abs(e - 60_000) <= 4 * sketches.standard_error(p) * 60_000


def test_small_sets_nulls_and_stored_sketches(spark, tmp_path, fx):
    m, lg, ct = fx.matches(ROWS), fx.leagues(LEAGUES), fx.countries({0: "Land"})
    m = m.unionByName(m.limit(1).withColumn("home_team_api_id", F.lit(None).cast("long")))
    op.write_sketches(op.team_sketches(m), str(tmp_path / "s"))
    stored = op.read_sketches(spark, str(tmp_path / "s"))
    assert [tuple(r) for r in op.approx_teams(stored, lg, ct).collect()] == [("Land", 6, 2, 2)]
    assert [tuple(r) for r in op.audit_teams(stored, m, lg, ct).collect()] == [("Land", 6, 2, 2, True)]
    only_null = op.team_sketches(m.where("home_team_api_id IS NULL"))
    assert only_null.select(F.hll_sketch_estimate("teams")).first()[0] == 0
    assert op.team_sketches(m.limit(0)).count() == 0
    # An estimate far off is told.
    wrong = stored.withColumn("teams", F.lit(op.team_sketches(_many(spark, 0, 500)).first().teams))
    assert not op.audit_teams(wrong, m, lg, ct).first().within_bound


NAMES = ["Zürich", "Zurich", "Élan", "elan", "Elan", "Eland", "Öst", "Oslo", "ost"]
UNICODE = ["elan", "Elan", "Élan", "Eland", "Oslo", "ost", "Öst", "Zurich", "Zürich"]


@pytest.mark.parametrize("collation,want", [("UNICODE", UNICODE), (None, sorted(NAMES)),
                                            ("sv", ["elan", "Elan", "Élan", "Eland", "Oslo", "ost", "Zurich", "Zürich", "Öst"])])
def test_names_in_the_order_of_a_collation(fx, collation, want):
    teams = fx.teams({i: n for i, n in enumerate(NAMES)})
    # Everybody draws with everybody's neighbour: all are level, so the standings list them by name.
    m = fx.matches([(i, 10, "2021", 1, "2021-01-01", i, (i + 1) % len(NAMES), 0, 0) for i in range(len(NAMES))])
    assert [r.team for r in op.standings(m, teams, fx.leagues(LEAGUES), collation=collation).collect()] == want
    for rows in (2, None):
        register = op.name_register(m, teams, fx.leagues(LEAGUES), collation, rows=rows)
        assert [(r.place, r.team) for r in register.collect()] == list(enumerate(want, 1))
    assert register.schema["team"].dataType.simpleString() == "string"


def test_names_that_a_collation_holds_equal_are_one_team(fx):
    m = fx.matches([(1, 10, "2021", 1, "2021-01-01", 1, 3, 1, 0), (2, 10, "2021", 2, "2021-01-02", 2, 3, 2, 0)])
    teams = fx.teams({1: "Étoile", 2: "etoile", 3: "Other"})
    got = [(r.team, r.matches, r.wins) for r in op.top_winners(m, teams, fx.leagues(LEAGUES), 1, 9, collation="UNICODE_CI_AI").collect()]
    assert got == [("etoile", 2, 2), ("Other", 2, 0)] or got == [("Étoile", 2, 2), ("Other", 2, 0)]
    assert got[0][0] == min("Étoile", "etoile", key=str.encode)
    assert op.top_winners(m, teams, fx.leagues(LEAGUES), 1, 9).count() == 3
