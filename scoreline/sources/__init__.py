"""Table sources: declared-schema readers and derived views."""

from scoreline.sources.football import FootballTables, parse_snapshot_dates, read_football
from scoreline.sources.layout import Layout, drop_layout, write_layout
from scoreline.sources.match_view import MatchTables, match_tables, teams_in_good_standing
from scoreline.sources.tables import read_table

__all__ = ["read_table", "match_tables", "MatchTables", "teams_in_good_standing",
           "read_football", "FootballTables",
           "write_layout", "drop_layout", "Layout", "parse_snapshot_dates"]
