"""Recent form and days of rest: hand-worked tables, chunked equal to whole, plans without a window over a team."""

import datetime as dt

import pytest

from conftest import SF01, plan_text
from scoreline import operators as op
from scoreline.sources import match_tables

TEAMS, LEAGUES = {1: "One", 2: "Two", 3: "Three"}, {10: "North", 20: "South"}
ROWS = [
    (1, 10, "2021", 1, "2021-01-01", 1, 2, 1, 0),
    (2, 20, "2021", 1, "2021-01-31", 3, 1, 1, 1),       # another league counts too
    (3, 10, "2021", 2, "2021-03-02", 1, 2, None, None),  # exactly 60 days after the first
    (4, 10, "2021", 3, "2021-03-03", 2, 1, 0, 4),        # the first has just left
    (5, 10, "2021", 3, "2021-03-03", 1, 3, 2, 2),        # the same day: peers
]


@pytest.fixture(scope="module")
def t(fx):
    return fx.matches(ROWS), fx.teams(TEAMS), fx.leagues(LEAGUES)


def _day(text):
    return dt.date.fromisoformat(text)


@pytest.mark.parametrize("rows", [1, None])
def test_recent_form(t, rows):
    got = {(r.team, r.match_id): (r.match_points, r.form_points, r.form_matches, r.form_goals) for r in op.recent_form(*t, rows=rows).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "One"} == {
        1: (3, 3, 1, 1), 2: (1, 4, 2, 2), 3: (0, 4, 3, 2), 4: (3, 5, 4, 7), 5: (1, 5, 4, 7)}
    assert got[("Two", 3)] == (0, 0, 2, 0) and len(got) == 10


def test_recent_form_without_dates_and_scores(fx):
    m = fx.matches([(1, 10, "2021", 1, "2021-01-01", 1, 2, None, None)]).unionByName(
        fx.matches(ROWS[:2]).selectExpr("id + 10 AS id", "country_id", "league_id", "season", "stage", "CAST(NULL AS TIMESTAMP_NTZ) AS date",
                                        "home_team_api_id", "away_team_api_id", "home_team_goal", "away_team_goal"))
    got = {(r.team, r.match_id): (r.match_date, r.form_points, r.form_matches, r.form_goals)
           for r in op.recent_form(m, fx.teams(TEAMS), fx.leagues(LEAGUES)).collect()}
    assert got[("One", 1)] == (_day("2021-01-01"), 0, 1, None)   # no goals are known
    assert got[("One", 11)] == got[("One", 12)] == (None, 4, 2, 2)  # matches without a date are peers


@pytest.mark.parametrize("rows", [1, None])
def test_rest_days(t, rows):
    got = {r.match_id: (r.prev_match_id, r.days_since, r.next_match_id, r.days_until) for r in op.rest_days(*t, rows=rows).collect() if r.team == "One"}
    assert got == {1: (None, None, 2, 30), 2: (1, 30, 3, 30), 3: (2, 30, 4, 1), 4: (3, 1, 5, 0), 5: (4, 0, None, None)}


def test_chunks_do_not_change_the_reports(spark):
    mt = match_tables(spark, SF01)
    for report in (op.recent_form, op.rest_days):
        whole, cut = report(mt.matches, mt.teams, mt.leagues), report(mt.matches, mt.teams, mt.leagues, rows=97)
        assert whole.exceptAll(cut).count() == 0 and whole.count() == cut.count() == 2 * mt.matches.count()
        plan = plan_text(cut, "simple")
        spans = [line for line in plan.split("\n") if "windowspecdefinition(" in line and "_chunk" not in line]
        assert all("_g0" in line for line in spans)  # only the one-row-a-chunk tables


def test_empty_matches(t):
    m, teams, leagues = t
    assert op.recent_form(m.limit(0), teams, leagues).count() == op.rest_days(m.limit(0), teams, leagues).count() == 0
