"""Match-level history of each team: recent form and days of rest.

Both look along a team's whole history, which may be a third of all matches, so they go through
``operators.scan``: no window spans a whole team.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.functions import points, sql_asc
from scoreline.operators.reshape import to_participants
from scoreline.operators.scan import neighbours, range_sums


def _named(df: DataFrame, teams: DataFrame, leagues: DataFrame) -> DataFrame:
    t = teams.select(F.col("team_api_id").alias("_t_id"), F.col("team_long_name").alias("team"))
    lg = leagues.select(F.col("id").alias("_l_id"), F.col("name").alias("league"))
    return df.join(t, F.col("team_api_id") == F.col("_t_id")).join(lg, F.col("league_id") == F.col("_l_id"))


def recent_form(matches: DataFrame, teams: DataFrame, leagues: DataFrame, days: int = 60, *, rows: int | None = None) -> DataFrame:
    """Every match of every team with the team's points, matches and goals of the last ``days`` days.

    The frame is SQL's ``RANGE BETWEEN days PRECEDING AND CURRENT ROW`` over the match date: all
    matches of the team, in any league, from ``days`` days before up to the same day, the match itself
    included. Matches without a date form a frame of their own. A match without a score brings no points
    and no goals; ``form_goals`` is NULL if no match of the frame has a score. ``rows`` is the size of a chunk.
    """
    long = (to_participants(matches.select("id", "league_id", F.col("date").cast("date").alias("match_date"), "home_team_api_id", "away_team_api_id",
                                           "home_team_goal", "away_team_goal"), keep=("id", "league_id", "match_date"))
            .where(F.col("team_api_id").isNotNull())
            .select("id", "league_id", "match_date", "team_api_id", "is_home", points("gf", "ga").alias("match_points"), "gf", F.lit(1).alias("_one"),
                    F.unix_date("match_date").alias("_day")))
    form = range_sums(long, ["team_api_id"], "_day", {"form_points": "match_points", "form_matches": "_one", "form_goals": "gf"}, days, rows=rows)
    return (_named(form, teams, leagues)
            .select("team", "league", "match_date", F.col("id").alias("match_id"), "match_points", "form_points", "form_matches", "form_goals")
            .orderBy(*sql_asc("team", "match_date", "match_id")))


def rest_days(matches: DataFrame, teams: DataFrame, leagues: DataFrame, *, rows: int | None = None) -> DataFrame:
    """Every match of every team with the days since its previous and until its next match.

    A team's matches follow (date, id), those without a date last, across leagues; the first has no previous
    one and the last no next one (NULL), and so has a neighbour without a date. ``prev_match_id`` and
    ``next_match_id`` name the neighbours.
    """
    long = (to_participants(matches, keep=("id", "league_id", "date")).where(F.col("team_api_id").isNotNull())
            .select("id", "league_id", "team_api_id", F.col("date").cast("date").alias("match_date"), "date"))
    near = neighbours(long, ["team_api_id"], ["date", "id"], ["id", "match_date"], nulls_last=True, rows=rows)
    return (_named(near, teams, leagues)
            .select("team", "league", "match_date", F.col("id").alias("match_id"),
                    F.col("prev_id").alias("prev_match_id"), F.datediff("match_date", "prev_match_date").cast("long").alias("days_since"),
                    F.col("next_id").alias("next_match_id"), F.datediff("next_match_date", "match_date").cast("long").alias("days_until"))
            .orderBy(*sql_asc("team", "match_date", "match_id")))
