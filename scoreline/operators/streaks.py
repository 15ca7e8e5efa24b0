"""Runs of consecutive matches: winning runs and unbeaten runs (gaps and islands).

For each team, matches are ordered by (date, match id). A run is a maximal
sequence of consecutive matches that all satisfy the run predicate (won;
or not lost). Every match that breaks runs increments a counter; the
counter value before a run-match is constant along a run and different
between runs, so it names the run ("island"). Grouping run-matches by
(team, league, island) gives each run's length and first/last date.

The counter is a running sum over each team's whole history — a
partition that can be arbitrarily large for one busy team — so it is
computed with ``operators.scan.running_sum`` in bounded blocks. The
grouping afterwards is a plain aggregation (partial aggregation map-side,
so one endless run is no hot spot either).

A run that crosses from one league to another is reported once per
league, each part with its own length (the grouping includes the league).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.functions import in_run, sql_asc
from scoreline.operators.reshape import to_participants
from scoreline.operators.scan import running_sum


def runs(matches: DataFrame, kind: str = "win", by_league: bool = True) -> DataFrame:
    """All runs: team_api_id, [league_id,] island, length, start_date, end_date, days.

    ``by_league=True`` reports a run that crosses leagues once per league (as
    the streak reports do); ``False`` keeps each run whole across leagues.
    """
    long = (to_participants(matches, keep=("id", "league_id", "date"))
            .withColumn("_in", in_run("gf", "ga", kind))
            .withColumn("_break", F.when(F.col("_in"), F.lit(0)).otherwise(F.lit(1))))
    # SQL order: ascending, NULL dates last.
    numbered = running_sum(long, ["team_api_id"], ["date", "id"], "_break", "island",
                           nulls_last=True)
    keys = ["team_api_id", "league_id", "island"] if by_league else ["team_api_id", "island"]
    return (numbered.filter(F.col("_in"))
            .groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("length"),
                 F.min("date").cast("date").alias("start_date"),
                 F.max("date").cast("date").alias("end_date"))
            .withColumn("days", F.datediff("end_date", "start_date").cast("long")))


def streaks(matches: DataFrame, teams: DataFrame, leagues: DataFrame, kind: str = "win",
            k: int = 10, exclude_leagues: Iterable[str] = ()) -> DataFrame:
    """Top k runs (several per team possible), longest first, then earliest start.

    ``kind="win"``: a draw, a loss or a match without a score ends a run.
    ``kind="unbeaten"``: only a loss (or a match without a score) ends it.
    """
    length_col = "wins_in_a_row" if kind == "win" else "unbeaten_matches"
    t = teams.select(F.col("team_api_id").alias("_t_id"), F.col("team_long_name").alias("team"))
    lg = leagues.select(F.col("id").alias("_l_id"), F.col("name").alias("league"))
    out = (runs(matches, kind)
           .join(t, F.col("team_api_id") == F.col("_t_id"))
           .join(lg, F.col("league_id") == F.col("_l_id")))
    names = list(exclude_leagues)
    if names:
        out = out.filter(~F.col("league").isin(names))
    return (out.orderBy(F.col("length").desc(),
                        *sql_asc("start_date", "team", "league", "end_date"))
            .limit(k)
            .select("team", "league", F.col("length").alias(length_col), "start_date",
                    "end_date", F.col("days").alias("streak_days")))


def longest_run_per_team(matches: DataFrame, teams: DataFrame, kind: str = "win") -> DataFrame:
    """The longest run of every team over its whole history (runs kept whole
    across leagues); on ties the earliest start, then the earliest end."""
    days = lambda c: F.datediff(c, F.lit("1970-01-01"))
    best = (runs(matches, kind, by_league=False)
            .groupBy("team_api_id")
            .agg(F.max_by(F.struct("length", "start_date", "end_date", "days"),
                          F.struct(F.col("length"), -days("start_date"), -days("end_date")))
                 .alias("best")))
    t = teams.select(F.col("team_api_id").alias("_t_id"), F.col("team_long_name").alias("team"))
    return (best.join(t, F.col("team_api_id") == F.col("_t_id"))
            .select("team", F.col("best.length").alias("length"),
                    F.col("best.start_date").alias("start_date"),
                    F.col("best.end_date").alias("end_date"), F.col("best.days").alias("streak_days")))
