"""League tables: season standings, gap to the leader, round-by-round table.

``season_table`` aggregates the long (team, match) rows per (team, league,
season) — map-side partial aggregation, one shuffle. Rankings then run on
those aggregated rows:

* ``standings`` keeps the top n per league-season with ``rank() <= n``;
  Catalyst plans that as a ``WindowGroupLimit`` below the shuffle, so each
  map task forwards at most n ranks (plus ties) per group.
* ``gap_to_leader`` needs rank = 2 and the leader's points. It keeps
  ``rank <= 2`` (a group limit), then takes the leader's points as a max over
  the surviving rows of the same partition, then keeps rank 2: one shuffle,
  no join (a whole-partition ``first_value`` next to the rank would prevent
  the group limit).
* ``running_standings`` is the cumulative table round by round: a running
  total per (league, season, team) and a rank per (league, season, round),
  both through ``operators.scan`` so no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreline.functions import collated, drawn, lost, points, sql_asc, won
from scoreline.operators.reshape import to_participants
from scoreline.operators.scan import rank_desc, running_sum, written

TIE_BREAKS = ("points", "goal_diff", "goals_for")


def season_table(matches: DataFrame, win: int = 3, draw: int = 1, loss: int = 0) -> DataFrame:
    """Per (team_api_id, league_id, season): points, won, drawn, lost, goals for/against, goal diff.

    A NULL score gives no points and counts as neither won, drawn nor lost.
    """
    long = to_participants(matches, keep=("league_id", "season"))
    gf, ga = F.col("gf"), F.col("ga")
    return (long.groupBy("team_api_id", "league_id", "season")
            .agg(F.sum(points(gf, ga, win, draw, loss)).alias("points"),
                 F.sum(won(gf, ga)).alias("won"),
                 F.sum(drawn(gf, ga)).alias("drawn"),
                 F.sum(lost(gf, ga)).alias("lost"),
                 F.sum(gf).alias("goals_for"),
                 F.sum(ga).alias("goals_against"),
                 F.sum(gf - ga).alias("goal_diff")))


RANKINGS = {"rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number}


def standings(matches: DataFrame, teams: DataFrame, leagues: DataFrame, top: int = 3,
              tie_breaks: Iterable[str] = TIE_BREAKS, method: str = "rank",
              collation: str | None = None) -> DataFrame:
    """The first ``top`` positions of every league-season.

    Positions follow the tie-break columns, all descending (NULL first).
    With ``method="rank"`` ties share a position and the next is skipped
    (1, 2, 2, 4), so more than ``top`` rows can come back; ``"dense_rank"``
    does not skip (1, 2, 2, 3); ``"row_number"`` numbers every team
    (ties then fall in team-id order). ``collation`` sorts the names of the
    result by a language's rules; it does not change positions.
    """
    table = season_table(matches)
    order = [F.col(c).desc_nulls_first() for c in tie_breaks]
    if method == "row_number":
        order.append(F.col("team_api_id").asc_nulls_last())
    w = Window.partitionBy("league_id", "season").orderBy(*order)
    ranked = table.withColumn("position", RANKINGS[method]().over(w).cast("long")) \
        .filter(F.col("position") <= top)
    t = teams.select(F.col("team_api_id").alias("_t_id"), F.col("team_long_name").alias("team"))
    lg = leagues.select(F.col("id").alias("_l_id"), F.col("name").alias("league"))
    return (ranked.join(t, F.col("team_api_id") == F.col("_t_id"))
            .join(lg, F.col("league_id") == F.col("_l_id"))
            .select("league", "season", "position", "team", "points", "won", "drawn", "lost",
                    "goals_for", "goals_against", "goal_diff")
            .orderBy(*sql_asc(collated("league", collation), "season", "position", collated("team", collation), "league", "team")))


def name_register(matches: DataFrame, teams: DataFrame, leagues: DataFrame, collation: str | None = "UNICODE", *,
                  rows: int | None = None) -> DataFrame:
    """The teams of every league in the order of their names: (league, place, team, team_api_id, matches).

    Names are ordered by ``collation`` (byte by byte if None), equal ones by team id. A league may have any number
    of teams: places are running sums over chunks of it (``rows`` each), not a window over the league.
    """
    played = to_participants(matches, keep=("league_id",)).groupBy("league_id", "team_api_id").agg(F.count(F.lit(1)).alias("matches"))
    t = teams.select(F.col("team_api_id").alias("_t_id"), F.col("team_long_name").alias("team"))
    lg = leagues.select(F.col("id").alias("_l_id"), F.col("name").alias("league"))
    named, n = written(played.join(t, F.col("team_api_id") == F.col("_t_id")).select("league_id", "team_api_id", "team", "matches"))
    ordered = named.withColumn("_name", collated("team", collation)).withColumn("_one", F.lit(1))
    placed = running_sum(ordered, ["league_id"], ["_name", "team_api_id"], "_one", "place", nulls_last=True, rows=rows, total=n)
    return (placed.join(lg, F.col("league_id") == F.col("_l_id"))
            .select("league", "place", "team", "team_api_id", "matches")
            .orderBy(*sql_asc(collated("league", collation), "place", "team_api_id")))


def gap_to_leader(matches: DataFrame, teams: DataFrame, leagues: DataFrame, position: int = 2,
                  exclude_seasons: Iterable[str] = (), exclude_leagues: Iterable[str] = (),
                  k: int = 15, widest: bool = False) -> DataFrame:
    """Teams finishing at ``position`` (rank on points only) and their gap to the leader.

    When two teams share first place there is no rank 2, and that
    league-season has no row. Exclusions apply after ranking. Top k by the
    smallest gap (the closest seasons), or by the largest with ``widest=True``.
    """
    table = season_table(matches).select("team_api_id", "league_id", "season", "points")
    group = Window.partitionBy("league_id", "season")
    # rank <= position is a group limit below the shuffle; the leader's rows
    # (rank 1) survive it, so the leader's points are a max over what is left,
    # on the same partitioning — no second shuffle and no join.
    at_position = (table.withColumn("_pos", F.rank().over(group.orderBy(F.col("points").desc_nulls_first())))
                   .filter(F.col("_pos") <= position)
                   .withColumn("leader_points", F.max("points").over(group))
                   .filter(F.col("_pos") == position))
    t = teams.select(F.col("team_api_id").alias("_t_id"), F.col("team_long_name").alias("runner_up"))
    lg = leagues.select(F.col("id").alias("_l_id"), F.col("name").alias("league"))
    out = (at_position
           .join(t, F.col("team_api_id") == F.col("_t_id"))
           .join(lg, F.col("league_id") == F.col("_l_id")))
    seasons, names = list(exclude_seasons), list(exclude_leagues)
    if seasons:
        out = out.filter(~F.col("season").isin(seasons))
    if names:
        out = out.filter(~F.col("league").isin(names))
    return (out.select("league", "season", "runner_up", F.col("points").alias("runner_up_points"),
                       "leader_points", (F.col("leader_points") - F.col("points")).alias("gap"))
            .orderBy(F.col("gap").desc_nulls_last() if widest else F.col("gap").asc_nulls_last(),
                     *sql_asc("league", "season", "runner_up"))
            .limit(k))


def running_standings(matches: DataFrame, teams: DataFrame, leagues: DataFrame,
                      league: str | None = None, season: str | None = None,
                      only_teams: Iterable[str] | None = None) -> DataFrame:
    """Points per match, cumulative points and position after every round.

    The running total follows (round, date, match id) within each (league,
    season, team); the position ranks every row of a round of a
    league-season by cumulative points (ties share). A team without a match
    in a round has no row in it. ``league`` / ``season`` select one
    league-season up front (a filter on group keys, pushed into the scan);
    ``only_teams`` is applied *after* ranking, so positions still count
    every team.
    """
    m = matches
    if season is not None:
        m = m.filter(F.col("season") == season)
    lg = leagues.select(F.col("id").alias("_l_id"), F.col("name").alias("league"))
    if league is not None:
        lg = lg.filter(F.col("league") == league)
        m = m.join(lg.select("_l_id"), F.col("league_id") == F.col("_l_id"), "left_semi")
    long = to_participants(m, keep=("id", "league_id", "season", "stage", "date")) \
        .withColumn("round_points", points("gf", "ga"))
    # SQL order: ascending, NULLs last.
    # Written once: the ranks read the totals for their histogram and for the result.
    totals, _ = written(running_sum(long, ["league_id", "season", "team_api_id"], ["stage", "date", "id"],
                                 "round_points", "total_points", nulls_last=True)
                     .select("league_id", "season", "stage", "date", "team_api_id", "round_points", "total_points"))
    ranked = rank_desc(totals, ["league_id", "season", "stage"], "total_points", "position")
    t = teams.select(F.col("team_api_id").alias("_t_id"), F.col("team_long_name").alias("team"))
    out = (ranked.join(lg, F.col("league_id") == F.col("_l_id"))
           .join(t, F.col("team_api_id") == F.col("_t_id")))
    if only_teams is not None:
        out = out.filter(F.col("team").isin(list(only_teams)))
    return (out.select("league", "season", F.col("stage").alias("round"),
                       F.col("date").cast("date").alias("match_date"), "team", "round_points",
                       "total_points", "position")
            .orderBy(*sql_asc("league", "season", "round", "position", "team", "match_date")))
