"""Gaps and islands: runs across leagues, same-day order, NULL scores, dual form."""

import datetime as dt

import pytest

from conftest import SF01
from scoreline import operators as op
from scoreline.sources import match_tables

TEAMS = {1: "One", 2: "Two", 3: "Three"}
LEAGUES = {10: "North", 20: "South"}


def _runs(df):
    return sorted(((r.team_api_id, r.league_id, r.length, str(r.start_date), str(r.end_date))
                   for r in df.collect()), key=lambda r: (r[0], r[1], r[3], r[4]))


def test_run_over_two_leagues_is_reported_per_league(fx):
    m = fx.matches([(1, 10, "2020", 1, "2020-01-01", 1, 2, 1, 0),
                    (2, 20, "2020", 1, "2020-01-02", 1, 3, 2, 0),
                    (3, 20, "2020", 1, "2020-01-03", 3, 1, 0, 1),
                    (4, 20, "2020", 1, "2020-01-04", 1, 3, 0, 1)])
    got = [r for r in _runs(op.runs(m, "win")) if r[0] == 1]
    assert got == [(1, 10, 1, "2020-01-01", "2020-01-01"), (1, 20, 2, "2020-01-02", "2020-01-03")]


def test_same_day_matches_follow_match_id(fx):
    m = fx.matches([(5, 10, "2020", 1, "2020-01-01", 1, 2, 1, 0),   # win
                    (6, 10, "2020", 1, "2020-01-01", 1, 3, 0, 1),   # loss, same day, later id
                    (7, 10, "2020", 1, "2020-01-02", 1, 2, 1, 0)])  # win
    got = [r for r in _runs(op.runs(m, "win")) if r[0] == 1]
    assert [r[2] for r in got] == [1, 1]


def test_unbeaten_run_through_draws_and_null_breaks(fx):
    m = fx.matches([(1, 10, "2020", 1, "2020-01-01", 1, 2, 1, 0),
                    (2, 10, "2020", 1, "2020-01-02", 1, 2, 0, 0),
                    (3, 10, "2020", 1, "2020-01-03", 1, 2, 2, 1),
                    (4, 10, "2020", 1, "2020-01-04", 1, 2, None, None),
                    (5, 10, "2020", 1, "2020-01-05", 1, 2, 1, 1)])
    unbeaten = [r for r in _runs(op.runs(m, "unbeaten")) if r[0] == 1]
    assert [(r[2], r[3], r[4]) for r in unbeaten] == [(3, "2020-01-01", "2020-01-03"),
                                                      (1, "2020-01-05", "2020-01-05")]
    wins = [r for r in _runs(op.runs(m, "win")) if r[0] == 1]
    assert [r[2] for r in wins] == [1, 1]


def test_streaks_report_columns_and_days(fx):
    m = fx.matches([(1, 10, "2020", 1, "2020-01-01", 1, 2, 1, 0),
                    (2, 10, "2020", 1, "2020-01-11", 1, 2, 1, 0)])
    rows = op.streaks(m, fx.teams(TEAMS), fx.leagues(LEAGUES), "win", k=10).collect()
    top = rows[0]
    assert (top.team, top.league, top.wins_in_a_row, top.streak_days) == ("One", "North", 2, 10)
    assert top.start_date == dt.date(2020, 1, 1)
    assert not op.streaks(m, fx.teams(TEAMS), fx.leagues(LEAGUES), "win",
                          exclude_leagues=["North"]).collect()


@pytest.mark.parametrize("kind", ["win", "unbeaten"])
def test_runs_equal_a_walk_through_each_teams_matches(spark, kind):
    m = match_tables(spark, SF01).matches
    sides = []
    for r in m.collect():
        for team, gf, ga in ((r.home_team_api_id, r.home_team_goal, r.away_team_goal),
                             (r.away_team_api_id, r.away_team_goal, r.home_team_goal)):
            sides.append((team, r.date, r.id, r.league_id, gf > ga if kind == "win" else gf >= ga))
    want, run, last = {}, 0, None
    for team, date, _, league, good in sorted(sides):
        if not good or team != last:
            run += 1
        last = team
        if good:
            start, end, n = want.get((team, run, league), (date, date, 0))
            want[team, run, league] = (min(start, date), max(end, date), n + 1)
    got = sorted((r.team_api_id, r.league_id, r.start_date, r.end_date, r.length) for r in op.runs(m, kind).collect())
    assert got == sorted((t, lg, a.date(), b.date(), n) for (t, _, lg), (a, b, n) in want.items())
    assert len(got) > 1000


@pytest.mark.parametrize("kind", ["win", "unbeaten"])
def test_runs_partition_the_qualifying_matches(spark, kind):
    # Disjoint and covering: run lengths add up to the matches that qualify.
    from pyspark.sql import functions as F
    from scoreline.functions import in_run
    m = match_tables(spark, SF01).matches
    qualifying = op.to_participants(m, keep=("id",)).filter(in_run("gf", "ga", kind)).count()
    total = op.runs(m, kind).agg(F.sum("length")).first()[0]
    assert total == qualifying
    # A run is reported in several parts only across leagues.
    parts = op.runs(m, kind).groupBy("team_api_id", "island").agg(F.count("*").alias("parts"))
    leagues = op.to_participants(m, keep=("league_id",)).groupBy("team_api_id") \
        .agg(F.countDistinct("league_id").alias("leagues"))
    assert parts.join(leagues, "team_api_id").filter("parts > leagues").count() == 0
    # Maximal: per team, a new run needs a break before it.
    islands = op.runs(m, kind).select("team_api_id", "island").distinct()
    breaks = (op.to_participants(m, keep=("id", "date"))
              .filter(~in_run("gf", "ga", kind)).groupBy("team_api_id").count())
    # islands of a team <= breaks + 1 (each new island needs a break before it)
    per_team = islands.groupBy("team_api_id").count().withColumnRenamed("count", "islands")
    over = per_team.join(breaks, "team_api_id", "left").filter(
        F.col("islands") > F.coalesce(F.col("count"), F.lit(0)) + 1)
    assert over.count() == 0
