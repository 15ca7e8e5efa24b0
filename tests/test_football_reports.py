"""The reports over the seven-table football model, read from CSV exports."""

import datetime as dt
import os
import tempfile

import pandas as pd
import pytest

from scoreline.plans.football_reports import REPORTS
from scoreline.sources.football import SCHEMAS, read_football

D = "2013-08-18 00:00:00"
TABLES = {
    "country": [(1, "Spain"), (2, "Belgium")],
    "league": [(1, 1, "Spain LIGA BBVA"), (2, 2, "Belgium Jupiler League")],
    "team": [(1, 100, "FC Barcelona", "BAR"), (2, 200, "Real Madrid CF", "REA"),
             (3, 300, "Atlético Madrid", "AMA"), (4, 400, "Sevilla FC", "SEV")],
    "player": [(1, 1000, "Lionel Messi"), (2, 2000, "Cristiano Ronaldo"), (3, 3000, "Someone Else")],
    "match": [
        (1, 1, 1, "2013/2014", 1, D, 501, 100, 400, 2, 0),
        (2, 1, 1, "2013/2014", 1, D, 502, 200, 300, 1, 1),
        (3, 1, 1, "2013/2014", 2, "2013-08-25 00:00:00", 503, 200, 100, 0, 2),
        (4, 1, 1, "2013/2014", 2, "2013-08-25 00:00:00", 504, 300, 400, 3, 0),
        (5, 1, 1, "2013/2014", 3, "2013-09-01 00:00:00", 505, 100, 200, 1, 1),
        (6, 1, 1, "2013/2014", 3, "2013-09-01 00:00:00", 506, 400, 300, 0, 6),
        (7, 2, 2, "2013/2014", 1, D, 507, 999, 100, 1, 0),          # unknown home team
    ],
    "player_attributes": [
        (1, 1000, "2008-02-22 00:00:00", 88, 90, 80, 90, 90, 90, 60, 60),
        (2, 1000, "2008-08-30 00:00:00", 90, 94, 80, 90, 90, 90, 60, 60),
        (3, 2000, "2008-08-30 00:00:00", 91, 93, 85, 85, 85, 90, 80, 85),
        (4, 1000, "2009-02-22 00:00:00", 92, 95, 85, 95, 95, 90, 60, 60),
        (5, 2000, "2009-02-22 00:00:00", 91, 93, 85, 85, 85, 90, 80, 85),
        (6, 9999, "2009-02-22 00:00:00", 50, 55, 40, 40, 40, 40, 40, 40),   # unknown player
    ],
    "team_attributes": [
        (1, 100, "2010-02-22 00:00:00", 30, 40, 50, 60, 70, 80, 50),
        (2, 100, "2011-02-22 00:00:00", 35, 40, 55, 60, 65, 80, 50),
        (3, 100, "2011-09-22 00:00:00", 24, 40, 52, 60, 66, 80, 50),
        (4, 400, "2010-02-22 00:00:00", 60, 40, 50, 60, 40, 80, 50),
    ],
}


@pytest.fixture(scope="module")
def tables(spark):
    folder = tempfile.mkdtemp(prefix="scoreline-football-")
    for name, rows in TABLES.items():
        cols = SCHEMAS[name].fieldNames()
        os.makedirs(f"{folder}/{name}")
        pd.DataFrame(rows, columns=cols).to_csv(f"{folder}/{name}/part-0.csv", index=False)
    return read_football(spark, folder, fmt="csv", options={"header": "true"})


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_other_formats_read_the_same(spark, tables, tmp_path, fmt):
    for name in SCHEMAS:
        getattr(tables, name).write.format(fmt).save(f"{tmp_path}/{name}")
    other = read_football(spark, str(tmp_path), fmt=fmt)
    for name in SCHEMAS:
        want, got = getattr(tables, name), getattr(other, name)
        assert got.schema == want.schema, name
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str), name


def test_every_report_runs(tables):
    for name, report in REPORTS.items():
        assert report(tables).collect() is not None, name


def test_round_by_round(tables):
    rows = REPORTS["round_by_round"](tables).collect()
    assert sorted((r.round, r.team, r.total_points, r.position) for r in rows) == sorted([
        (1, "FC Barcelona", 3, 1), (1, "Real Madrid CF", 1, 2), (1, "Atlético Madrid", 1, 2),
        (2, "FC Barcelona", 6, 1), (2, "Atlético Madrid", 4, 2), (2, "Real Madrid CF", 1, 3),
        (3, "FC Barcelona", 7, 1), (3, "Atlético Madrid", 7, 1), (3, "Real Madrid CF", 2, 3)])


def test_rivalry(tables):
    rows = REPORTS["rivalry"](tables).collect()
    assert [(r.match_date, r.round, r.venue, r.scoreline, r.winner, r.total_goals) for r in rows] == [
        (dt.date(2013, 8, 25), 2, "Santiago Bernabéu", "Real Madrid CF 0-2 FC Barcelona", "FC Barcelona", 2),
        (dt.date(2013, 9, 1), 3, "Camp Nou", "FC Barcelona 1-1 Real Madrid CF", "Draw", 2)]


def test_player_duel_and_tactics(tables):
    duel = REPORTS["player_duel"](tables).collect()
    assert [(r.period, r.messi, r.cristiano, r.difference) for r in duel] == [(2008, 90, 91, -1),
                                                                          (2009, 92, 91, 1)]
    tac = REPORTS["tactical_evolution"](tables).collect()
    assert [(r.team, r.year, r.speed, r.prev_speed, r.delta_speed, r.mean_speed, r.pressure,
             r.delta_pressure, r.mean_pressure, r.chance_creation_passing) for r in tac] == [
        ("FC Barcelona", 2010, 30, None, None, 27.0, 70, None, 68.0, 50),
        ("FC Barcelona", 2011, 24, 30, -6, 27.0, 66, -4, 68.0, 52)]


def test_schema_checks(tables):
    rep = {(r.kind, r.constraint_name): r.violations for r in REPORTS["schema_checks"](tables).collect()}
    assert rep[("clean", "match orphans")] == 1
    assert rep[("clean", "player_attributes orphans")] == 1
    assert rep[("clean", "team_attributes orphans")] == 0
    assert all(v == 0 for (kind, _), v in rep.items() if kind != "clean")
    assert len(rep) == 3 + 7 + 2 + 7


def test_final_tables(tables):
    rows = REPORTS["final_tables"](tables).filter("league = 'Spain LIGA BBVA'").collect()
    assert sorted((r.position, r.team, r.points, r.won, r.drawn, r.lost, r.goals_for, r.goals_against, r.goal_diff)
                  for r in rows) == [
        (1, "Atlético Madrid", 7, 2, 1, 0, 10, 1, 9), (2, "FC Barcelona", 7, 2, 1, 0, 5, 1, 4),
        (3, "Real Madrid CF", 2, 0, 2, 1, 2, 4, -2)]
