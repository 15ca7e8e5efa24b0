"""The registered queries: each operator run over the driver's whole tables.

Every entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame. Matches
and their dimensions come from ``sources.match_view`` (derived from line
items, orders, customers, nations, regions and suppliers); snapshots come
from ``events`` (per event type, per day) and ``orders`` (per customer, per
year). Parameters below are the report settings for this data; selections
by name or pattern are the reports' own features (a head-to-head is about
one pair), never a way to shrink the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline import operators as op
from scoreline.session import checkpoint_dir
from scoreline.sources import MatchTables, match_tables, read_table, teams_in_good_standing, write_layout

# Report settings for the driver's data (fixed values).
MIN_MATCHES = 12            # top_winners, scoring_profile, high_scoring
MIN_HOME_MATCHES = 8        # home_advantage
MIN_MARGIN = 5              # biggest_margins
FORM_DAYS = 60              # recent_form
EXCLUDED_SEASONS = ["2001"]          # the last year is incomplete (orders stop in August)
EXCLUDED_LEAGUES = ["NATION_24"]
RIVALS = ("Supplier#000000014", "Supplier#000000099")
RIVAL_VENUES = ("Ground 14", "Ground 99")
EARLIEST = "1990-01-01"     # snapshot dates before it are quarantined
EVENT_SELECT = ["%CLICK%", "%Purchase%"]
EVENT_COLUMNS = [("click", "%click%"), ("purchase", "%purchase%")]
ABRUPT_PRIORITY_CHANGE = 3  # priorities run 1..5
ONE_LEAGUE, ONE_SEASON = "NATION_7", "1996"
SOME_TEAMS = ("Supplier#000000003", "Supplier#000000014", "Supplier#000000042")
SOME_CUSTOMERS = ("Customer#000000010", "Customer#000000077")


def _refs(good: DataFrame):
    return [("home_team_api_id", good, "team_api_id"), ("away_team_api_id", good, "team_api_id")]


def _two_spellings(teams: DataFrame) -> DataFrame:
    """Teams in pairs whose names differ in case and accent only, as two sources may spell them."""
    n = F.call_function("div", F.col("team_api_id"), F.lit(2)).cast("string")
    return teams.select("team_api_id", F.when(F.col("team_api_id") % 2 == 0, F.concat(F.lit("ÉTOILE "), n))
                        .otherwise(F.concat(F.lit("etoile "), n)).alias("team_long_name"))


def _accented(teams: DataFrame) -> DataFrame:
    """Teams whose names hold accented and capital letters instead of digits."""
    return teams.select("team_api_id", F.translate(F.substring("team_long_name", 10, 9), "0123456789", "aÁbÉeZzñNö").alias("team_long_name"))


def _audit_teams(mt: MatchTables, good: DataFrame) -> DataFrame:
    # Stored per league and season, then read back: the counts per country come from the stored rows.
    path = _new_folder(mt.matches.sparkSession, "sketches")
    op.write_sketches(op.team_sketches(mt.matches), path)
    return op.audit_teams(op.read_sketches(mt.matches.sparkSession, path), mt.matches, mt.leagues, mt.countries)


# Reports over any match tables: (MatchTables, parent team table) -> DataFrame.
MATCH_REPORTS: dict[str, Callable[[MatchTables, DataFrame], DataFrame]] = {
    "group_overview": lambda mt, good: op.group_overview(mt.matches, mt.leagues, mt.countries),
    "top_winners": lambda mt, good: op.top_winners(mt.matches, mt.teams, mt.leagues, MIN_MATCHES, 10),
    "home_advantage": lambda mt, good: op.home_advantage(mt.matches, mt.teams, mt.leagues,
                                                         MIN_HOME_MATCHES, 15),
    "biggest_margins": lambda mt, good: op.biggest_margins(mt.matches, mt.teams, mt.leagues,
                                                           MIN_MARGIN, 15),
    "scoring_profile": lambda mt, good: op.scoring_profile(mt.matches, mt.teams, mt.leagues,
                                                           MIN_MATCHES, 10),
    "scoring_profile_both": lambda mt, good: op.scoring_profile_both(mt.matches, mt.teams, mt.leagues,
                                                                     MIN_MATCHES, 10),
    "high_scoring": lambda mt, good: op.high_scoring(mt.matches, mt.teams, mt.leagues, MIN_MATCHES, 10),
    "margin_tallies": lambda mt, good: op.margin_tallies(mt.matches, mt.teams, MIN_MARGIN),
    "season_standings": lambda mt, good: op.standings(mt.matches, mt.teams, mt.leagues, top=3),
    "gap_to_leader": lambda mt, good: op.gap_to_leader(mt.matches, mt.teams, mt.leagues, 2,
                                                       EXCLUDED_SEASONS, EXCLUDED_LEAGUES, 15),
    "season_standings_row_number": lambda mt, good: op.standings(mt.matches, mt.teams, mt.leagues, top=3,
                                                                 method="row_number"),
    "gap_to_leader_all": lambda mt, good: op.gap_to_leader(mt.matches, mt.teams, mt.leagues, 2, k=15),
    "running_standings_selected": lambda mt, good: op.running_standings(
        mt.matches, mt.teams, mt.leagues, league=ONE_LEAGUE, season=ONE_SEASON, only_teams=SOME_TEAMS),
    "widest_gaps": lambda mt, good: op.gap_to_leader(mt.matches, mt.teams, mt.leagues, 2,
                                                     EXCLUDED_SEASONS, EXCLUDED_LEAGUES, 15,
                                                     widest=True),
    "running_standings": lambda mt, good: op.running_standings(mt.matches, mt.teams, mt.leagues),
    "win_streaks": lambda mt, good: op.streaks(mt.matches, mt.teams, mt.leagues, "win", 10,
                                               EXCLUDED_LEAGUES),
    "unbeaten_streaks": lambda mt, good: op.streaks(mt.matches, mt.teams, mt.leagues, "unbeaten", 10,
                                                    EXCLUDED_LEAGUES),
    "longest_win_per_team": lambda mt, good: op.longest_run_per_team(mt.matches, mt.teams, "win"),
    "recent_form": lambda mt, good: op.recent_form(mt.matches, mt.teams, mt.leagues, FORM_DAYS),
    "rest_days": lambda mt, good: op.rest_days(mt.matches, mt.teams, mt.leagues),
    "head_to_head": lambda mt, good: op.head_to_head(mt.matches, mt.teams, RIVALS[0], RIVALS[1],
                                                     RIVAL_VENUES),
    "head_to_head_summary": lambda mt, good: op.head_to_head_summary(mt.matches, mt.teams,
                                                                     RIVALS[0], RIVALS[1]),
    "head_to_head_report": lambda mt, good: op.head_to_head_report(mt.matches, mt.teams, RIVALS[0], RIVALS[1], RIVAL_VENUES),
    "overview_rollup": lambda mt, good: op.overview_rollup(mt.matches, mt.leagues, mt.countries),
    "approx_teams_audit": _audit_teams,
    "top_winners_merged": lambda mt, good: op.top_winners(mt.matches, _two_spellings(mt.teams), mt.leagues, MIN_MATCHES, 25,
                                                          collation="UNICODE_CI_AI"),
    "name_register": lambda mt, good: op.name_register(mt.matches, _accented(mt.teams), mt.leagues),
    "drop_orphans": lambda mt, good: op.drop_orphans(mt.matches, _refs(good)),
    "check_fk": lambda mt, good: op.check_fks([
        ("fk_match_home_team", mt.matches, "home_team_api_id", good, "team_api_id"),
        ("fk_match_away_team", mt.matches, "away_team_api_id", good, "team_api_id"),
        ("fk_match_league", mt.matches, "league_id", mt.leagues, "id"),
        ("fk_match_country", mt.matches, "country_id", mt.countries, "id"),
    ]),
}


def _on_driver_tables(key: str) -> Callable[[SparkSession, str], DataFrame]:
    report = MATCH_REPORTS[key]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(match_tables(spark, sf_dir), teams_in_good_standing(spark, sf_dir))

    run.__name__ = key
    return run


def compare_latest(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    entities = events.select(F.col("event_type").alias("entity"),
                             F.col("event_type").alias("name")).distinct()
    # The timestamp travels as text, as dated snapshots often do, and is
    # parsed back inside the operator.
    snapshots = events.select(F.col("event_type").alias("entity"), "event_id",
                              F.col("ts").cast("string").alias("ts_text"),
                              F.round(F.col("value") * 100).cast("long").alias("value_cents"))
    return op.compare_latest(entities, snapshots, key="entity", name="name", ts="ts_text",
                             order_id="event_id", metric="value_cents", select=EVENT_SELECT,
                             columns=EVENT_COLUMNS, period="day")


def _dirty_events(spark, sf_dir) -> DataFrame:
    """Events whose text dates are now and then missing, blank, malformed or absurd, as imports have them."""
    n = F.col("event_id")
    text = (F.when(n % 97 == 0, "n/a").when(n % 89 == 0, F.concat(F.substring(F.col("ts").cast("string"), 1, 5), F.lit("13-45")))
            .when(n % 83 == 0, F.lit(None)).when(n % 79 == 0, "  ").when(n % 73 == 0, "0199-01-01 00:00:00").otherwise(F.col("ts").cast("string")))
    return (read_table(spark, sf_dir, "events")
            .select(F.col("event_type").alias("entity"), "event_id", text.alias("ts_text"), F.round(F.col("value") * 100).cast("long").alias("value_cents")))


def quarantine_counts(spark, sf_dir):
    _, bad = op.split_dates(_dirty_events(spark, sf_dir), "ts_text", not_before=EARLIEST)
    return op.quarantine_counts(bad, "event_id")


def compare_latest_tolerant(spark, sf_dir):
    good, _ = op.split_dates(_dirty_events(spark, sf_dir), "ts_text", not_before=EARLIEST)
    entities = good.select("entity", F.col("entity").alias("name")).distinct()
    return op.compare_latest(entities, good, key="entity", name="name", ts="snapshot_ts", order_id="event_id", metric="value_cents",
                             select=EVENT_SELECT, columns=EVENT_COLUMNS, period="day")


def yearly_evolution(spark, sf_dir, abrupt: dict | None = None, only=None):
    customer = read_table(spark, sf_dir, "customer")
    orders = read_table(spark, sf_dir, "orders")
    entities = customer.select(F.col("c_custkey").alias("custkey"), "c_name")
    snapshots = orders.select(F.col("o_custkey").alias("custkey"), "o_orderdate", "o_orderkey",
                              F.round(F.col("o_totalprice") * 100).cast("long").alias("price_cents"),
                              F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
                              F.col("o_orderstatus").alias("status"))
    return op.yearly_evolution(entities, snapshots, key="custkey", name="c_name",
                               ts="o_orderdate", order_id="o_orderkey",
                               metrics=["price_cents", "priority"], passthrough=["status"],
                               name_as="customer", abrupt=abrupt, only=only)


def abrupt_changes(spark, sf_dir):
    return yearly_evolution(spark, sf_dir, abrupt={"priority": ABRUPT_PRIORITY_CHANGE})


def yearly_evolution_selected(spark, sf_dir):
    return yearly_evolution(spark, sf_dir, only=SOME_CUSTOMERS)


def check_unique(spark, sf_dir):
    lineitem = read_table(spark, sf_dir, "lineitem")
    return op.check_unique(lineitem, ["l_orderkey", "l_linenumber"], primary=True)


def _customers_in_good_standing(customer: DataFrame) -> DataFrame:
    """Customers with a non-negative balance: the parent table of the single-key clean-up."""
    return customer.filter(F.col("c_acctbal") >= 0)


def drop_orphans_single(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    good = _customers_in_good_standing(read_table(spark, sf_dir, "customer"))
    return op.drop_orphans(orders, [("o_custkey", good, "c_custkey")])


def integrity_report(spark, sf_dir):
    mt = match_tables(spark, sf_dir)
    good = teams_in_good_standing(spark, sf_dir)
    # All checks of the cleaned table are one pass over it, so it is not stored.
    kept = op.drop_orphans(mt.matches, _refs(good))
    customer = read_table(spark, sf_dir, "customer")
    orders = read_table(spark, sf_dir, "orders")
    kept_orders = op.drop_orphans(orders, [("o_custkey", _customers_in_good_standing(customer), "c_custkey")])
    return op.integrity_report(
        clean=[("match orphans", mt.matches, kept), ("orders orphans", orders, kept_orders)],
        primary_keys=[("match.id", kept, ["id"]), ("team.team_api_id", mt.teams, ["team_api_id"]),
                      ("league.id", mt.leagues, ["id"]), ("country.id", mt.countries, ["id"]),
                      ("customer.c_custkey", customer, ["c_custkey"]),
                      ("orders.o_orderkey", orders, ["o_orderkey"])],
        unique_keys=[("team.team_long_name", mt.teams, ["team_long_name"]),
                     ("customer.c_name", customer, ["c_name"])],
        foreign_keys=[("fk_match_home_team", kept, "home_team_api_id", good, "team_api_id"),
                      ("fk_match_away_team", kept, "away_team_api_id", good, "team_api_id"),
                      ("fk_match_league", kept, "league_id", mt.leagues, "id"),
                      ("fk_match_country", kept, "country_id", mt.countries, "id"),
                      ("fk_league_country", mt.leagues, "country_id", mt.countries, "id"),
                      ("fk_orders_customer", orders, "o_custkey", customer, "c_custkey")])


def _new_folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/scoreline/{name}-{uuid.uuid4().hex}"


def clean_counts(spark, sf_dir):
    mt = match_tables(spark, sf_dir)
    customer, orders = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders")
    _, matches = op.write_clean(mt.matches, _refs(teams_in_good_standing(spark, sf_dir)), _new_folder(spark, "clean-matches"))
    _, kept = op.write_clean(orders, [("o_custkey", _customers_in_good_standing(customer), "c_custkey")], _new_folder(spark, "clean-orders"))
    return op.clean_counts(spark, [("match orphans", matches), ("orders orphans", kept)])


def publish_audit(spark, sf_dir):
    mt, good = match_tables(spark, sf_dir), teams_in_good_standing(spark, sf_dir)
    done = op.publish(mt.matches, _new_folder(spark, "published"), refs=_refs(good), primary_keys=[("match.id", ["id"])],
                      foreign_keys=[("fk_match_home_team", "home_team_api_id", good, "team_api_id"),
                                    ("fk_match_away_team", "away_team_api_id", good, "team_api_id"),
                                    ("fk_match_league", "league_id", mt.leagues, "id")])
    return (spark.createDataFrame(done.report).select("kind", "constraint_name", "violations", F.lit(done.counts["kept"]).cast("long").alias("published_rows")))


def _layout(spark, sf_dir):
    mt, name = match_tables(spark, sf_dir), f"scoreline_{uuid.uuid4().hex}"
    return mt, write_layout(mt, name, _new_folder(spark, "layout"), buckets=16)


def top_winners_layout(spark, sf_dir):
    mt, layout = _layout(spark, sf_dir)
    return op.top_winners(layout.sides, layout.teams, mt.leagues, MIN_MATCHES, 10)


def head_to_head_layout(spark, sf_dir):
    mt, layout = _layout(spark, sf_dir)
    return op.head_to_head(layout.matches, layout.teams, *RIVALS, RIVAL_VENUES, ids=op.team_ids(mt.teams, *RIVALS))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{key: _on_driver_tables(key) for key in MATCH_REPORTS if key not in ("drop_orphans", "check_fk")},
    "compare_latest": compare_latest,
    "yearly_evolution": yearly_evolution,
    "yearly_evolution_selected": yearly_evolution_selected,
    "abrupt_changes": abrupt_changes,
    "drop_orphans": _on_driver_tables("drop_orphans"),
    "drop_orphans_single": drop_orphans_single,
    "check_unique": check_unique,
    "check_fk": _on_driver_tables("check_fk"),
    "integrity_report": integrity_report,
    "quarantine_counts": quarantine_counts,
    "compare_latest_tolerant": compare_latest_tolerant,
    "clean_counts": clean_counts,
    "publish_audit": publish_audit,
    "top_winners_layout": top_winners_layout,
    "head_to_head_layout": head_to_head_layout,
}
