"""Standings over a stream of match files.

The reports are one-shot queries over a closed history; nothing in them is
stateful beyond aggregation. What carries over to Structured Streaming is
the season table — a plain grouped aggregation over the long form — which
can be kept up to date as match files arrive (update / complete mode).
Rank-based reports are then run on the table a stream maintains.
"""

from scoreline.streaming.standings import (live_season_table, match_stream, read_live_table,
                                           start_live_table)

__all__ = ["match_stream", "live_season_table", "read_live_table", "start_live_table"]
