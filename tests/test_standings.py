"""League tables: ranks, ties, NULL scores, running totals; properties on driver data."""

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from scoreline import operators as op
from scoreline.sources import match_tables

TEAMS = {i: f"T{i}" for i in range(1, 11)}
LEAGUES = {10: "North", 20: "South", 30: "East"}
ROWS = [
    # North 2021: teams 1 and 2 tie on points; 2 has the better goal difference
    (1, 10, "2021", 1, "2021-01-01", 1, 3, 1, 0),
    (2, 10, "2021", 1, "2021-01-01", 2, 4, 2, 0),
    (3, 10, "2021", 2, "2021-02-01", 1, 2, 1, 1),
    (4, 10, "2021", 2, "2021-02-01", 3, 4, 0, 0),
    # South 2021: four teams all level
    (5, 20, "2021", 1, "2021-01-01", 5, 6, 0, 0),
    (6, 20, "2021", 1, "2021-01-01", 7, 8, 0, 0),
    # East 2021: one match without a score
    (7, 30, "2021", 1, "2021-01-01", 9, 10, None, None),
]


@pytest.fixture(scope="module")
def t(fx):
    return fx.matches(ROWS), fx.teams(TEAMS), fx.leagues(LEAGUES)


def test_standings_tie_breaks_and_ties(t):
    m, tm, lg = t
    rows = op.standings(m, tm, lg, top=3).collect()
    north = [(r.position, r.team, r.points, r.goal_diff) for r in rows if r.league == "North"]
    assert north == [(1, "T2", 4, 2), (2, "T1", 4, 1), (3, "T3", 1, -1)]
    south = [r for r in rows if r.league == "South"]
    assert len(south) == 4 and {r.position for r in south} == {1}   # ties: more than 3 rows
    east = {r.team: r for r in rows if r.league == "East"}
    assert all((r.points, r.won, r.drawn, r.lost) == (0, 0, 0, 0) for r in east.values())


def test_gap_to_leader_has_no_rank_two_when_first_is_shared(t):
    m, tm, lg = t
    rows = op.gap_to_leader(m, tm, lg, position=2, k=100).collect()
    assert not [r for r in rows if r.league in ("North", "South", "East")]


def test_gap_to_leader_values_and_exclusions(fx):
    m = fx.matches([(1, 10, "2021", 1, "2021-01-01", 1, 2, 3, 0),
                    (2, 10, "2021", 2, "2021-02-01", 1, 3, 1, 0),
                    (3, 10, "2021", 3, "2021-03-01", 2, 3, 2, 1),
                    (4, 10, "2022", 1, "2022-01-01", 1, 2, 1, 0)])
    tm, lg = fx.teams(TEAMS), fx.leagues(LEAGUES)
    rows = {r.season: r for r in op.gap_to_leader(m, tm, lg, position=2, k=100).collect()}
    assert (rows["2021"].runner_up, rows["2021"].runner_up_points, rows["2021"].leader_points,
            rows["2021"].gap) == ("T2", 3, 6, 3)
    assert (rows["2022"].runner_up, rows["2022"].gap) == ("T2", 3)
    assert not op.gap_to_leader(m, tm, lg, exclude_seasons=["2021", "2022"]).collect()
    assert not op.gap_to_leader(m, tm, lg, exclude_leagues=["North"]).collect()


def test_running_standings_positions_count_all_teams(t):
    m, tm, lg = t
    rows = op.running_standings(m, tm, lg, league="North", season="2021", only_teams=["T3"]).collect()
    assert [(r.round, r.round_points, r.total_points, r.position) for r in rows] == \
        [(1, 0, 0, 3), (2, 1, 1, 3)]   # ranked among all four teams, then filtered


def test_running_standings_missing_round(fx):
    m = fx.matches([(1, 10, "2021", 1, "2021-01-01", 1, 2, 1, 0),
                    (2, 10, "2021", 2, "2021-02-01", 1, 3, 1, 0)])
    rows = op.running_standings(m, fx.teams(TEAMS), fx.leagues(LEAGUES)).collect()
    assert {(r.round, r.team) for r in rows} == {(1, "T1"), (1, "T2"), (2, "T1"), (2, "T3")}


@pytest.fixture(scope="module")
def driver(spark):
    return match_tables(spark, SF01)


def test_properties_on_driver_data(driver):
    m = driver.matches
    table = op.season_table(m)
    s = table.agg(F.sum("won").alias("w"), F.sum("lost").alias("l"), F.sum("drawn").alias("d"),
                  F.sum("points").alias("p")).first()
    assert s.w == s.l
    assert s.p == 3 * s.w + s.d
    assert op.to_participants(m).count() == 2 * m.count()


def test_last_running_total_is_season_total(driver):
    run = op.running_standings(driver.matches, driver.teams, driver.leagues)
    last = run.groupBy("league", "season", "team").agg(F.max("total_points").alias("pts"))
    table = op.standings(driver.matches, driver.teams, driver.leagues, top=10**6) \
        .select("league", "season", "team", "points")
    diff = last.join(table, ["league", "season", "team"]).filter(F.col("pts") != F.col("points"))
    assert diff.count() == 0
    assert last.count() == table.count()


def test_standings_ranking_methods(t):
    m, tm, lg = t
    for method, expected in (("rank", [1, 1, 1, 1]), ("dense_rank", [1, 1, 1, 1]),
                             ("row_number", [1, 2, 3])):
        south = op.standings(m, tm, lg, top=3, method=method).filter("league = 'South'").collect()
        assert sorted(r.position for r in south) == expected, method
    north = op.standings(m, tm, lg, top=4, method="dense_rank").filter("league = 'North'").collect()
    assert [r.position for r in north] == [1, 2, 3, 4]
