"""Every match report against its SQL oracle on random tables with NULLs.

The driver's tables hold no NULLs and no orphans; here scores, dates and team
ids are sometimes NULL, one team id has no team row, ties are frequent, and
every report of ``MATCH_REPORTS`` must equal its oracle query run by DuckDB
on the same rows.
"""

import datetime as dt
import random

import duckdb
import pandas as pd
import pytest

from parity import compare
from scoreline.plans.catalog import MATCH_REPORTS
from scoreline.plans.oracle import ORACLE_SQL, over_base_tables
from scoreline.sources.match_view import MATCH_SCHEMA, MatchTables

TEAM_IDS = [1, 2, 3, 5, 14, 99]


def tables(seed: int):
    rnd = random.Random(seed)
    teams = [(i, f"Supplier#{i:09d}") for i in TEAM_IDS]
    leagues = [(23, 1, "NATION_23"), (24, 2, "NATION_24")]
    countries = [(1, "AFRICA"), (2, "ASIA")]
    good = [t for t in teams if t[0] != 5]
    pool = TEAM_IDS + [7]                       # 7 has no team row
    rows = []
    for i in range(1, 901):
        league = rnd.choice([23, 24])
        season = rnd.choice(["1999", "2000", "2001"])
        stage = rnd.randint(1, 12)
        date = None if rnd.random() < 0.03 else dt.datetime(int(season), stage, rnd.randint(1, 3))
        home, away = rnd.sample(pool, 2)
        home = None if rnd.random() < 0.02 else home
        away = None if rnd.random() < 0.02 else away
        hg = None if rnd.random() < 0.05 else rnd.randint(0, 6)
        ag = None if rnd.random() < 0.05 else rnd.randint(0, 6)
        rows.append((i, {23: 1, 24: 2}[league], league, season, stage, date, home, away, hg, ag))
    return rows, teams, leagues, countries, good


@pytest.fixture(scope="module", params=[1])
def both(spark, request):
    rows, teams, leagues, countries, good = tables(request.param)
    mt = MatchTables(
        matches=spark.createDataFrame(rows, MATCH_SCHEMA),
        teams=spark.createDataFrame(teams, "team_api_id long, team_long_name string"),
        leagues=spark.createDataFrame(leagues, "id int, country_id int, name string"),
        countries=spark.createDataFrame(countries, "id int, name string"))
    good_df = spark.createDataFrame(good, "team_api_id long, team_long_name string")
    con = duckdb.connect()
    int_cols = {"id": "Int64", "country_id": "Int32", "league_id": "Int32", "stage": "Int32",
                "home_team_api_id": "Int64", "away_team_api_id": "Int64",
                "home_team_goal": "Int32", "away_team_goal": "Int32"}
    m = pd.DataFrame(rows, columns=MATCH_SCHEMA.fieldNames()).astype(int_cols)
    m["date"] = pd.to_datetime(m["date"])
    con.register("matches", m)
    con.register("teams", pd.DataFrame(teams, columns=["team_api_id", "team_long_name"]))
    con.register("good_teams", pd.DataFrame(good, columns=["team_api_id", "team_long_name"]))
    con.register("leagues", pd.DataFrame(leagues, columns=["id", "country_id", "name"]))
    con.register("countries", pd.DataFrame(countries, columns=["id", "name"]))
    return mt, good_df, con


@pytest.mark.parametrize("key", sorted(MATCH_REPORTS))
def test_report_matches_oracle_with_nulls(spark, both, key):
    mt, good, con = both
    _check(spark, mt, good, con, key)


def _check(spark, mt, good, con, key):
    sql = over_base_tables(ORACLE_SQL[key])
    res = compare(spark, con, key, lambda s, _: MATCH_REPORTS[key](mt, good), sql, "")
    assert res.get("match"), res
    assert res["spark_rows"] > 0 or key in ("head_to_head", "running_standings_selected"), res
