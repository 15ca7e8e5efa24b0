"""Head-to-head history between two named teams, in either home/away order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.functions import sql_asc

DRAW_LABEL = "Draw"


def team_ids(teams: DataFrame, *names: str, most: int = 1000) -> list:
    """The ids of the teams of these names, looked up now; raises if more than ``most`` teams share them."""
    found = [r[0] for r in teams.filter(F.col("team_long_name").isin(*names)).select("team_api_id").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} teams are called {names}")
    return sorted(i for i in found if i is not None)


def _pair(matches: DataFrame, teams: DataFrame, team_a: str, team_b: str, ids: list | None = None) -> DataFrame:
    home = teams.select(F.col("team_api_id").alias("_h_id"), F.col("team_long_name").alias("home_team"))
    away = teams.select(F.col("team_api_id").alias("_a_id"), F.col("team_long_name").alias("away_team"))
    h, a = F.col("home_team"), F.col("away_team")
    if ids is not None:  # these reach the files' statistics and bloom filters
        met = matches.filter(F.col("home_team_api_id").isin(ids) & F.col("away_team_api_id").isin(ids))
    else:
        # The ids of the two names are one scalar row; with them the scan of the
        # matches is filtered on both sides before any exchange or join.
        found = (teams.filter(F.col("team_long_name").isin(team_a, team_b))
                 .select(F.collect_set("team_api_id")).scalar())
        met = matches.filter(F.array_contains(found, F.col("home_team_api_id"))
                             & F.array_contains(found, F.col("away_team_api_id")))
    return (met.join(home, F.col("home_team_api_id") == F.col("_h_id"))
            .join(away, F.col("away_team_api_id") == F.col("_a_id"))
            .filter(((h == team_a) & (a == team_b)) | ((h == team_b) & (a == team_a))))


def head_to_head(matches: DataFrame, teams: DataFrame, team_a: str, team_b: str,
                 venues: tuple[str, str] = ("Home of A", "Home of B"), ids: list | None = None) -> DataFrame:
    """Every match between ``team_a`` and ``team_b``, by date.

    ``venues`` names the ground of each side: a match is placed at
    ``venues[0]`` when ``team_a`` plays at home, otherwise at ``venues[1]``.
    The winner of a draw, or of a match without a score, is "Draw". ``ids`` are the
    pair's ``team_ids`` if they are known; the scan then skips files by them.
    """
    hg, ag = F.col("home_team_goal"), F.col("away_team_goal")
    h, a = F.col("home_team"), F.col("away_team")
    return (_pair(matches, teams, team_a, team_b, ids)
            .select(F.col("date").cast("date").alias("match_date"), "season",
                    F.col("stage").alias("round"),
                    F.when(h == team_a, F.lit(venues[0])).otherwise(F.lit(venues[1])).alias("venue"),
                    F.concat(h, F.lit(" "), hg.cast("string"), F.lit("-"), ag.cast("string"),
                             F.lit(" "), a).alias("scoreline"),
                    F.when(hg > ag, h).when(hg < ag, a).otherwise(F.lit(DRAW_LABEL)).alias("winner"),
                    (hg + ag).alias("total_goals"))
            .orderBy(*sql_asc("match_date", "round", "scoreline")))


def head_to_head_summary(matches: DataFrame, teams: DataFrame, team_a: str, team_b: str) -> DataFrame:
    """One balance row for the pair: meetings, wins of each side, draws, goals."""
    hg, ag = F.col("home_team_goal"), F.col("away_team_goal")
    h, a = F.col("home_team"), F.col("away_team")
    a_won = ((h == team_a) & (hg > ag)) | ((a == team_a) & (ag > hg))
    b_won = ((h == team_b) & (hg > ag)) | ((a == team_b) & (ag > hg))
    n = F.count(F.lit(1))
    return (_pair(matches, teams, team_a, team_b)
            .agg(n.alias("meetings"), F.count_if(a_won).alias("wins_a"),
                 F.count_if(b_won).alias("wins_b"),
                 (n - F.count_if(a_won) - F.count_if(b_won)).alias("draws"),
                 F.sum(hg + ag).alias("total_goals"))
            .select(F.lit(team_a).alias("team_a"), F.lit(team_b).alias("team_b"), "*"))


def head_to_head_report(matches: DataFrame, teams: DataFrame, team_a: str, team_b: str,
                        venues: tuple[str, str] = ("Home of A", "Home of B")) -> DataFrame:
    """Detail and balance of a pair in one result: every meeting, each season, each venue and all of them.

    ``level`` is "match", "season", "venue" or "all" (GROUPING SETS over the meetings, which are read once); columns
    that a level does not group by are NULL. A match row has its date, scoreline and winner, the others counts
    and goals over their meetings. A meeting without a score is a draw, as in ``head_to_head``. No meeting: no rows.
    """
    hg, ag = F.col("home_team_goal"), F.col("away_team_goal")
    at_home = F.col("home_team") == team_a
    met = _pair(matches, teams, team_a, team_b).select(
        "id", "season", F.when(at_home, F.lit(venues[0])).otherwise(F.lit(venues[1])).alias("venue"),
        F.col("date").cast("date").alias("day"), F.col("stage"),
        F.when(at_home, hg).otherwise(ag).alias("a"), F.when(at_home, ag).otherwise(hg).alias("b"),
        F.concat("home_team", F.lit(" "), hg.cast("string"), F.lit("-"), ag.cast("string"), F.lit(" "), "away_team").alias("text"))
    a, b = F.col("a"), F.col("b")
    n, wins_a, wins_b = F.count(F.lit(1)), F.count_if(a > b), F.count_if(b > a)
    one = F.grouping("id") == 0
    level = (F.when(one, "match").when(F.grouping("season") == 0, "season").when(F.grouping("venue") == 0, "venue").otherwise("all"))
    sets = [["id", "season", "venue"], ["season"], ["venue"], []]
    return (met.groupingSets([[F.col(c) for c in s] for s in sets], F.col("id"), F.col("season"), F.col("venue"))
            .agg(level.alias("level"), F.when(one, F.max("day")).alias("match_date"), F.when(one, F.max("stage")).alias("round"),
                 F.when(one, F.max("text")).alias("scoreline"),
                 F.when(one, F.when(wins_a > 0, team_a).when(wins_b > 0, team_b).otherwise(DRAW_LABEL)).alias("winner"),
                 n.alias("meetings"), wins_a.alias("wins_a"), wins_b.alias("wins_b"), (n - wins_a - wins_b).alias("draws"),
                 F.sum("a").alias("goals_a"), F.sum("b").alias("goals_b"))
            .select("level", "season", "venue", "match_date", "round", "scoreline", "winner", "meetings", "wins_a", "wins_b", "draws",
                    "goals_a", "goals_b")
            .orderBy(F.expr("array_position(array('match', 'season', 'venue', 'all'), level)"), *sql_asc("match_date", "season", "venue", "scoreline")))
