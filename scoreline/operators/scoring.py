"""Aggregate reports over matches: overview, winners, home advantage,
biggest margins, scoring profile, high-scoring teams.

All are one (or two, sharing one exchange) hash aggregations with map-side
partial aggregation, so a team or league holding a third of the matches
costs one partial row per map task before the shuffle. Dimension names are
joined onto aggregated rows; the exceptions are ``group_overview``, which groups by the
names themselves, and ``biggest_margins``, which lists matches. Reports that group by
*names* (two entities with one name merge, as intended) aggregate per id
first and merge per name after the join — exact, since counts and sums add.

Top-k reports end in ``orderBy(...).limit(k)`` (``TakeOrderedAndProject``:
a k-row heap per partition). Their sort keys are the report's own keys
followed by enough tie-breakers that the k rows are always the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.functions import avg_rounded, collated, mean, pct, result, sql_asc
from scoreline.functions.outcomes import LOSS, WIN, DRAW
from scoreline.functions.rounding import half_up, half_up_wide
from scoreline.operators.reshape import to_participants


def _names(df: DataFrame, teams: DataFrame, leagues: DataFrame,
           team_key: str = "team_api_id", league_key: str = "league_id") -> DataFrame:
    t = teams.select(F.col("team_api_id").alias("_t_id"), F.col("team_long_name").alias("team"))
    lg = leagues.select(F.col("id").alias("_l_id"), F.col("name").alias("league"))
    return (df.join(t, F.col(team_key) == F.col("_t_id"))
              .join(lg, F.col(league_key) == F.col("_l_id"))
              .drop("_t_id", "_l_id"))


def group_overview(matches: DataFrame, leagues: DataFrame, countries: DataFrame) -> DataFrame:
    """Per (country name, league name): size, goals, home/away/draw rates, date range.

    Leagues join countries through the league's own country id. Matches
    without a league or country are dropped (inner joins). The team count
    counts distinct *home* teams.
    """
    h, a = F.col("home_team_goal"), F.col("away_team_goal")
    goals = h + a
    lg = leagues.select(F.col("id").alias("_l_id"), F.col("country_id").alias("_l_cid"),
                        F.col("name").alias("league"))
    ct = countries.select(F.col("id").alias("_c_id"), F.col("name").alias("country"))
    return (
        matches.join(lg, F.col("league_id") == F.col("_l_id"))
        .join(ct, F.col("_l_cid") == F.col("_c_id"))
        .groupBy("country", "league")
        .agg(F.count(F.lit(1)).alias("matches"),
             F.countDistinct("home_team_api_id").alias("teams"),
             F.sum(goals).alias("total_goals"),
             avg_rounded(goals, 2).alias("goals_per_match"),
             pct(F.count_if(h > a), F.count(F.lit(1))).alias("pct_home_wins"),
             pct(F.count_if(h < a), F.count(F.lit(1))).alias("pct_away_wins"),
             pct(F.count_if(h == a), F.count(F.lit(1))).alias("pct_draws"),
             F.min("date").cast("date").alias("first_date"),
             F.max("date").cast("date").alias("last_date"))
        .orderBy(F.col("goals_per_match").desc_nulls_first(), *sql_asc("country", "league"))
    )


def overview_rollup(matches: DataFrame, leagues: DataFrame, countries: DataFrame) -> DataFrame:
    """``group_overview`` with subtotals: per league, per country and over all, in one result.

    ``level`` is "league", "country" or "all" (ROLLUP); names that a level does not group by are NULL. The
    matches are aggregated per (league id, home team) first, so the three levels are made of those rows and never
    of the matches; teams are counted once per level. No matches: no rows.
    """
    h, a = F.col("home_team_goal"), F.col("away_team_goal")
    n = F.count(F.lit(1))
    per_team = matches.groupBy("league_id", "home_team_api_id").agg(
        n.alias("n"), F.sum(h + a).alias("goals"), F.count(h + a).alias("scored"), F.count_if(h > a).alias("h"),
        F.count_if(h < a).alias("a"), F.count_if(h == a).alias("d"), F.min("date").alias("first"), F.max("date").alias("last"))
    lg = leagues.select(F.col("id").alias("_l_id"), F.col("country_id").alias("_l_cid"), F.col("name").alias("league"))
    ct = countries.select(F.col("id").alias("_c_id"), F.col("name").alias("country"))
    named = per_team.join(lg, F.col("league_id") == F.col("_l_id")).join(ct, F.col("_l_cid") == F.col("_c_id"))
    level = F.when(F.grouping_id() == 0, "league").when(F.grouping_id() == 1, "country").otherwise("all")
    return (named.rollup("country", "league")
            .agg(level.alias("level"), F.sum("n").alias("matches"), F.countDistinct("home_team_api_id").alias("teams"),
                 F.sum("goals").alias("total_goals"), mean(F.sum("goals"), F.sum("scored"), 2).alias("goals_per_match"),
                 pct(F.sum("h"), F.sum("n")).alias("pct_home_wins"), pct(F.sum("a"), F.sum("n")).alias("pct_away_wins"),
                 pct(F.sum("d"), F.sum("n")).alias("pct_draws"),
                 F.min("first").cast("date").alias("first_date"), F.max("last").cast("date").alias("last_date"))
            .select("level", "country", "league", "matches", "teams", "total_goals", "goals_per_match", "pct_home_wins",
                    "pct_away_wins", "pct_draws", "first_date", "last_date")
            .orderBy(F.col("country").asc_nulls_last(), F.col("league").asc_nulls_last()))


def top_winners(matches: DataFrame, teams: DataFrame, leagues: DataFrame,
                min_matches: int = 150, k: int = 10, collation: str | None = None) -> DataFrame:
    """W/D/L record per (team name, league name) with at least ``min_matches``; top k by wins.

    With a ``collation`` names that it holds equal (case, accents) are one team, shown by the smallest spelling,
    and ties in wins are ordered by it.

    A NULL score counts as a draw. Counts are first aggregated per (team id,
    league id) — the names are joined onto those few rows, not onto every
    match — and then merged per name, which is exact because counts add up.
    """
    long = to_participants(matches, keep=("league_id",)) \
        .withColumn("result", result("gf", "ga", null_as="draw"))
    r = F.col("result")
    per_id = long.groupBy("team_api_id", "league_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(r == WIN).alias("_w"),
        F.count_if(r == DRAW).alias("_d"), F.count_if(r == LOSS).alias("_l"))
    return (
        _names(per_id, teams, leagues)
        .groupBy(collated("team", collation).alias("_team"), collated("league", collation).alias("_league"))
        .agg(F.min("team").alias("team"), F.min("league").alias("league"),
             F.sum("_n").alias("matches"), F.sum("_w").alias("wins"),
             F.sum("_d").alias("draws"), F.sum("_l").alias("losses"))
        .filter(F.col("matches") >= min_matches)
        .withColumn("pct_wins", pct("wins", "matches"))
        .orderBy(F.col("wins").desc(), *sql_asc("_team", "_league"))
        .limit(k)
        .drop("_team", "_league")
    )


def home_advantage(matches: DataFrame, teams: DataFrame, leagues: DataFrame,
                   min_home: int = 100, k: int = 15, same_league: bool = False) -> DataFrame:
    """Home win rate, away win rate and their gap per team, top k by gap.

    Home records are per (team, league); away records are per (team, league)
    too, but the two are joined on the team only (``same_league=False``), so
    a team that played in several leagues gets one row per pair of home
    league and away league. ``same_league=True`` joins on both keys.
    The gap is rounded once, from the exact difference of the two rates.

    Size: the records are aggregates (one row per team and league), and the
    team-only pairing yields at most L_home x L_away rows per team, where L is
    the number of leagues the team played in — a small domain constant, not
    a function of the number of matches; the top-k then keeps k rows.
    """
    won = F.col("gf") > F.col("ga")
    record = (to_participants(matches, keep=("league_id",)).groupBy("team_api_id", "league_id")
              .agg(F.count_if(F.col("is_home")).alias("home_matches"), F.count_if(F.col("is_home") & won).alias("home_wins"),
                   F.count_if(~F.col("is_home")).alias("away_matches"), F.count_if(~F.col("is_home") & won).alias("away_wins")))
    # One row per team with its few records at home and away; the pairs are made inside the row, so the
    # matches are read and aggregated once.
    home = F.when(F.col("home_matches") >= min_home, F.struct("league_id", "home_matches", "home_wins"))
    away = F.when(F.col("away_matches") > 0, F.struct(F.col("league_id").alias("_a_league"), "away_matches", "away_wins"))
    per_team = (record.groupBy("team_api_id").agg(F.collect_list(home).alias("_homes"), F.collect_list(away).alias("_aways"))
                .where((F.size("_homes") > 0) & (F.size("_aways") > 0)))
    t = teams.select(F.col("team_api_id").alias("_t_id"), F.col("team_long_name").alias("team"))
    lg = leagues.select(F.col("id").alias("_l_id"), F.col("name").alias("league"))
    pairs = (per_team.join(t, F.col("team_api_id") == F.col("_t_id"))
             .select("team", "_aways", F.inline("_homes")).select("team", "league_id", "home_matches", "home_wins", F.inline("_aways")))
    if same_league:
        pairs = pairs.where(F.col("league_id") == F.col("_a_league"))
    hm, hw, am, aw = (F.col(c) for c in ("home_matches", "home_wins", "away_matches", "away_wins"))
    # Products of two counts leave 64 bits beyond some 60 million matches, from there on the gap is exact in 38 digits.
    hm_, hw_, am_, aw_ = (c.cast("decimal(19,0)") for c in (hm, hw, am, aw))
    wide = half_up_wide(F.lit(100).cast("decimal(3,0)") * (hw_ * am_ - aw_ * hm_), hm_ * am_, 1)
    gap = F.when(F.greatest(hm, am) < 60_000_000, half_up(100 * (hw * am - aw * hm), hm * am, 1)).otherwise(wide)
    return (
        pairs.join(lg, F.col("league_id") == F.col("_l_id"))
        .select("team", "league", "home_matches", "home_wins",
                pct(hw, hm).alias("pct_home_wins"), "away_matches", "away_wins",
                pct(aw, am).alias("pct_away_wins"), gap.alias("home_away_gap"))
        .orderBy(F.col("home_away_gap").desc_nulls_first(),
                 *sql_asc("team", "league", "home_matches", "home_wins", "away_matches", "away_wins"))
        .limit(k)
    )


def biggest_margins(matches: DataFrame, teams: DataFrame, leagues: DataFrame,
                    min_margin: int = 5, k: int = 15) -> DataFrame:
    """Matches won by at least ``min_margin`` goals; top k by margin, then total goals."""
    h, a = F.col("home_team_goal"), F.col("away_team_goal")
    home = teams.select(F.col("team_api_id").alias("_h_id"), F.col("team_long_name").alias("_home"))
    away = teams.select(F.col("team_api_id").alias("_a_id"), F.col("team_long_name").alias("_away"))
    lg = leagues.select(F.col("id").alias("_l_id"), F.col("name").alias("league"))
    home_won = h > a
    return (
        matches.filter(F.abs(h - a) >= min_margin)
        .join(home, F.col("home_team_api_id") == F.col("_h_id"))
        .join(away, F.col("away_team_api_id") == F.col("_a_id"))
        .join(lg, F.col("league_id") == F.col("_l_id"))
        .orderBy(F.abs(h - a).desc(), (h + a).desc(), *sql_asc("id"))
        .limit(k)
        .select(F.col("date").cast("date").alias("match_date"), "league", "season", "stage",
                F.concat(F.col("_home"), F.lit(" "), h.cast("string"), F.lit("-"),
                         a.cast("string"), F.lit(" "), F.col("_away")).alias("scoreline"),
                F.when(home_won, F.col("_home")).otherwise(F.col("_away")).alias("winner"),
                F.when(home_won, F.col("_away")).otherwise(F.col("_home")).alias("loser"),
                F.abs(h - a).alias("margin"), (h + a).alias("total_goals"))
    )


def _profile(matches: DataFrame, min_matches: int) -> DataFrame:
    long = to_participants(matches, keep=("league_id",))
    return (long.groupBy("team_api_id", "league_id")
            .agg(F.count(F.lit(1)).alias("matches"),
                 avg_rounded("gf", 2).alias("goals_for_pg"),
                 avg_rounded("ga", 2).alias("goals_against_pg"),
                 avg_rounded(F.col("gf") - F.col("ga"), 2).alias("goal_diff_pg"))
            .filter(F.col("matches") >= min_matches))


def scoring_profile(matches: DataFrame, teams: DataFrame, leagues: DataFrame,
                    min_matches: int = 150, k: int = 10, category: str = "Top scorers",
                    by: str = "attack") -> DataFrame:
    """Mean goals for / against / difference per (team id, league id); top k.

    ``by="attack"`` ranks by goals for (highest first); ``by="defence"``
    ranks by goals against (lowest first). Means are rounded before ranking.
    """
    if by == "attack":
        first = F.col("goals_for_pg").desc_nulls_first()
    elif by == "defence":
        first = F.col("goals_against_pg").asc_nulls_last()
    else:
        raise ValueError(f"by must be 'attack' or 'defence', not {by!r}")
    return (
        _names(_profile(matches, min_matches), teams, leagues)
        .orderBy(first, *sql_asc("team", "league", "team_api_id", "league_id"))
        .limit(k)
        .select(F.lit(category).alias("category"), "team", "league", "matches",
                "goals_for_pg", "goals_against_pg", "goal_diff_pg")
    )


def scoring_profile_both(matches: DataFrame, teams: DataFrame, leagues: DataFrame,
                         min_matches: int = 150, k: int = 10) -> DataFrame:
    """Best attacks and best defences, one labelled list (both rankings)."""
    attack = scoring_profile(matches, teams, leagues, min_matches, k, "Top scorers", "attack")
    defence = scoring_profile(matches, teams, leagues, min_matches, k, "Best defences", "defence")
    return attack.unionByName(defence)


def high_scoring(matches: DataFrame, teams: DataFrame, leagues: DataFrame,
                 min_matches: int = 150, k: int = 10, over: int = 3) -> DataFrame:
    """Goals per match (both sides), share of matches with >= ``over`` goals and of 0-0s.

    Grouped by (team name, league name); top k by goals per match. As in
    ``top_winners``, sums and counts are aggregated per id before the names
    are joined, then merged per name.
    """
    long = to_participants(matches, keep=("league_id",)) \
        .withColumn("match_goals", F.col("gf") + F.col("ga"))
    g = F.col("match_goals")
    per_id = long.groupBy("team_api_id", "league_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(g).alias("_goals"), F.count(g).alias("_scored"),
        F.count_if(g >= over).alias("_over"), F.count_if(g == 0).alias("_nil"))
    return (
        _names(per_id, teams, leagues)
        .groupBy("team", "league")
        .agg(F.sum("_n").alias("matches"), F.sum("_goals").alias("_goals"),
             F.sum("_scored").alias("_scored"), F.sum("_over").alias("over_2_5"),
             F.sum("_nil").alias("nil_nil"))
        .filter(F.col("matches") >= min_matches)
        .select("team", "league", "matches",
                mean("_goals", "_scored", 2).alias("goals_per_match"), "over_2_5",
                pct("over_2_5", "matches").alias("pct_over_2_5"), "nil_nil",
                pct("nil_nil", "matches").alias("pct_nil_nil"))
        .orderBy(F.col("goals_per_match").desc_nulls_first(), *sql_asc("team", "league"))
        .limit(k)
    )


def margin_tallies(matches: DataFrame, teams: DataFrame, min_margin: int = 5) -> DataFrame:
    """How often each team won and lost by at least ``min_margin`` goals.

    One aggregation over the long form of the wide-margin matches only (the
    margin filter is pushed into the scan); teams with neither are absent.
    """
    big = matches.filter(F.abs(F.col("home_team_goal") - F.col("away_team_goal")) >= min_margin)
    long = to_participants(big, keep=())
    t = teams.select(F.col("team_api_id").alias("_t_id"), F.col("team_long_name").alias("team"))
    return (long.groupBy("team_api_id")
            .agg(F.count_if(F.col("gf") > F.col("ga")).alias("big_wins"),
                 F.count_if(F.col("gf") < F.col("ga")).alias("big_losses"))
            .join(t, F.col("team_api_id") == F.col("_t_id"))
            .select("team", "big_wins", "big_losses")
            .orderBy(F.col("big_wins").desc(), F.col("big_losses").desc(), *sql_asc("team")))
