"""The fourteen reports and the integrity sequence over the seven-table football model.

For users who hold that data (``sources.read_football``): each report is the
operator from ``scoreline.operators`` with the original report settings.
Nothing here is registered with the driver, whose tables have another shape;
``plans.catalog`` runs the same operators over the driver's tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline import operators as op
from scoreline.sources.football import FootballTables

# Original report settings (fixed values).
MIN_MATCHES = 150
MIN_HOME_MATCHES = 100
MIN_MARGIN = 5
EXCLUDED_SEASON = "2013/2014"
EXCLUDED_LEAGUE = "Belgium Jupiler League"
ROUND_BY_ROUND_LEAGUE = "Spain LIGA BBVA"
ROUND_BY_ROUND_SEASON = "2013/2014"
ROUND_BY_ROUND_TEAMS = ["FC Barcelona", "Real Madrid CF", "Atlético Madrid"]
RIVALS = ("FC Barcelona", "Real Madrid CF")
RIVAL_VENUES = ("Camp Nou", "Santiago Bernabéu")
PLAYER_SELECT = ["%Lionel Messi%", "%Cristiano Ronaldo%"]
PLAYER_COLUMNS = [("messi", "%messi%"), ("cristiano", "%cristiano ronaldo%")]
TACTICS_TEAMS = ["FC Barcelona", "Real Madrid CF", "FC Bayern Munich", "Juventus",
                 "Manchester United", "Chelsea", "Paris Saint-Germain", "Ajax"]


def _dims(t: FootballTables):
    teams = t.team.select("team_api_id", "team_long_name")
    leagues = t.league.select("id", "country_id", "name")
    return teams, leagues


def league_overview(t: FootballTables) -> DataFrame:
    return op.group_overview(t.match, t.league, t.country)


def top_winners(t: FootballTables) -> DataFrame:
    return op.top_winners(t.match, *_dims(t), MIN_MATCHES, 10)


def home_strength(t: FootballTables) -> DataFrame:
    return op.home_advantage(t.match, *_dims(t), MIN_HOME_MATCHES, 15)


def biggest_wins(t: FootballTables) -> DataFrame:
    return op.biggest_margins(t.match, *_dims(t), MIN_MARGIN, 15)


def top_scorers(t: FootballTables) -> DataFrame:
    return op.scoring_profile(t.match, *_dims(t), MIN_MATCHES, 10)


def entertainment(t: FootballTables) -> DataFrame:
    return op.high_scoring(t.match, *_dims(t), MIN_MATCHES, 10)


def final_tables(t: FootballTables) -> DataFrame:
    return op.standings(t.match, *_dims(t), top=3)


def closest_runners_up(t: FootballTables) -> DataFrame:
    return op.gap_to_leader(t.match, *_dims(t), 2, [EXCLUDED_SEASON], [EXCLUDED_LEAGUE], 15)


def round_by_round(t: FootballTables) -> DataFrame:
    return op.running_standings(t.match, *_dims(t), league=ROUND_BY_ROUND_LEAGUE,
                                season=ROUND_BY_ROUND_SEASON, only_teams=ROUND_BY_ROUND_TEAMS)


def win_streaks(t: FootballTables) -> DataFrame:
    return op.streaks(t.match, *_dims(t), "win", 10, [EXCLUDED_LEAGUE])


def unbeaten_streaks(t: FootballTables) -> DataFrame:
    return op.streaks(t.match, *_dims(t), "unbeaten", 10, [EXCLUDED_LEAGUE])


def rivalry(t: FootballTables) -> DataFrame:
    return op.head_to_head(t.match, t.team, RIVALS[0], RIVALS[1], RIVAL_VENUES)


def player_duel(t: FootballTables) -> DataFrame:
    return op.compare_latest(t.player, t.player_attributes, key="player_api_id", name="player_name",
                             ts="date", order_id="id", metric="overall_rating",
                             select=PLAYER_SELECT, columns=PLAYER_COLUMNS, period="year")


def tactical_evolution(t: FootballTables) -> DataFrame:
    snaps = t.team_attributes.select(
        "id", "team_api_id", "date", F.col("buildUpPlaySpeed").alias("speed"),
        F.col("defencePressure").alias("pressure"),
        F.col("chanceCreationPassing").alias("chance_creation_passing"))
    return op.yearly_evolution(t.team, snaps, key="team_api_id", name="team_long_name", ts="date",
                               order_id="id", metrics=["speed", "pressure"],
                               passthrough=["chance_creation_passing"], only=TACTICS_TEAMS,
                               name_as="team")


def clean_matches(t: FootballTables) -> FootballTables:
    """The orphan clean-up: matches with an unknown home or away team, and
    snapshots of unknown players / teams, are removed."""
    team, player = t.team, t.player
    return FootballTables(
        country=t.country, league=t.league, team=team, player=player,
        match=op.drop_orphans(t.match, [("home_team_api_id", team, "team_api_id"),
                                        ("away_team_api_id", team, "team_api_id")]),
        player_attributes=op.drop_orphans(t.player_attributes, [("player_api_id", player, "player_api_id")]),
        team_attributes=op.drop_orphans(t.team_attributes, [("team_api_id", team, "team_api_id")]))


def schema_checks(t: FootballTables) -> DataFrame:
    """Clean-up, 7 primary keys, 2 natural keys, 7 foreign keys — one report."""
    c = clean_matches(t)
    return op.integrity_report(
        clean=[("match orphans", t.match, c.match),
               ("player_attributes orphans", t.player_attributes, c.player_attributes),
               ("team_attributes orphans", t.team_attributes, c.team_attributes)],
        primary_keys=[(f"{n}.id", getattr(c, n), ["id"]) for n in
                      ("country", "league", "team", "player", "match", "player_attributes",
                       "team_attributes")],
        unique_keys=[("team.team_api_id", c.team, ["team_api_id"]),
                     ("player.player_api_id", c.player, ["player_api_id"])],
        foreign_keys=[("fk_league_country", c.league, "country_id", c.country, "id"),
                      ("fk_match_country", c.match, "country_id", c.country, "id"),
                      ("fk_match_league", c.match, "league_id", c.league, "id"),
                      ("fk_match_home_team", c.match, "home_team_api_id", c.team, "team_api_id"),
                      ("fk_match_away_team", c.match, "away_team_api_id", c.team, "team_api_id"),
                      ("fk_player_attr_player", c.player_attributes, "player_api_id", c.player,
                       "player_api_id"),
                      ("fk_team_attr_team", c.team_attributes, "team_api_id", c.team, "team_api_id")])


REPORTS: dict[str, Callable[[FootballTables], DataFrame]] = {
    "league_overview": league_overview,
    "top_winners": top_winners,
    "home_strength": home_strength,
    "biggest_wins": biggest_wins,
    "top_scorers": top_scorers,
    "entertainment": entertainment,
    "final_tables": final_tables,
    "closest_runners_up": closest_runners_up,
    "round_by_round": round_by_round,
    "win_streaks": win_streaks,
    "unbeaten_streaks": unbeaten_streaks,
    "rivalry": rivalry,
    "player_duel": player_duel,
    "tactical_evolution": tactical_evolution,
    "schema_checks": schema_checks,
}
