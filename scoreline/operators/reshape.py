"""Wide -> long: one row per participant per match.

A match row holds both sides (home and away id and score). Most reports
need one row per team per match. ``to_participants`` builds both rows from a
single scan with ``inline(array(struct(home...), struct(away...)))`` — a
narrow ``Generate`` with no shuffle — where a ``UNION ALL`` of two
projections would scan (and here: derive) the match table twice.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTICIPANT_FIELDS = ["team_api_id", "opponent_api_id", "is_home", "gf", "ga"]


def to_participants(matches: DataFrame, keep: Iterable[str] = ("league_id", "season")) -> DataFrame:
    """Columns: ``keep`` + team_api_id, opponent_api_id, is_home, gf, ga.

    ``gf``/``ga`` are goals for and against from that team's side. Only the
    ``keep`` columns are carried, so the scan below reads no more than that. Rows that are
    sides of matches already (a stored layout's) are taken as they are.
    """
    if "team_api_id" in matches.columns and "home_team_api_id" not in matches.columns:
        return matches.select(*keep, *PARTICIPANT_FIELDS)
    home = F.struct(F.col("home_team_api_id").alias("team_api_id"),
                    F.col("away_team_api_id").alias("opponent_api_id"),
                    F.lit(True).alias("is_home"),
                    F.col("home_team_goal").alias("gf"),
                    F.col("away_team_goal").alias("ga"))
    away = F.struct(F.col("away_team_api_id").alias("team_api_id"),
                    F.col("home_team_api_id").alias("opponent_api_id"),
                    F.lit(False).alias("is_home"),
                    F.col("away_team_goal").alias("gf"),
                    F.col("home_team_goal").alias("ga"))
    return matches.select(*keep, F.inline(F.array(home, away)))
