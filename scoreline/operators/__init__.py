"""DataFrame -> DataFrame operators over matches, snapshots and keys."""

from scoreline.operators.form import recent_form, rest_days
from scoreline.operators.integrity import (check_fk, check_fks, check_unique, clean_counts, drop_orphans,
                                           enforce, integrity_report, write_clean)
from scoreline.operators.matchups import head_to_head, head_to_head_report, head_to_head_summary, team_ids
from scoreline.operators.publish import current_version, publish, read_published
from scoreline.operators.quarantine import quarantine_counts, split_dates
from scoreline.operators.reshape import to_participants
from scoreline.operators.scan import neighbours, range_sums, rank_desc, running_sum, running_sums
from scoreline.operators.scoring import (biggest_margins, group_overview, high_scoring,
                                         home_advantage, margin_tallies, overview_rollup, scoring_profile,
                                         scoring_profile_both, top_winners)
from scoreline.operators.sketches import (approx_teams, audit_teams, merge_sketches, read_sketches,
                                          team_sketches, write_sketches)
from scoreline.operators.snapshots import compare_latest, latest_per_period, yearly_evolution
from scoreline.operators.standings import gap_to_leader, name_register, running_standings, season_table, standings
from scoreline.operators.streaks import longest_run_per_team, runs, streaks

__all__ = [
    "to_participants", "running_sum", "running_sums", "range_sums", "neighbours", "rank_desc",
    "recent_form", "rest_days",
    "group_overview", "top_winners", "home_advantage", "biggest_margins", "scoring_profile",
    "scoring_profile_both", "high_scoring", "margin_tallies", "overview_rollup",
    "team_sketches", "merge_sketches", "write_sketches", "read_sketches", "approx_teams", "audit_teams",
    "season_table", "standings", "name_register", "gap_to_leader", "running_standings",
    "runs", "streaks", "longest_run_per_team",
    "team_ids", "head_to_head", "head_to_head_report", "head_to_head_summary",
    "latest_per_period", "compare_latest", "yearly_evolution",
    "drop_orphans", "check_unique", "check_fk", "check_fks", "integrity_report", "enforce",
    "write_clean", "clean_counts", "publish", "read_published", "current_version", "split_dates", "quarantine_counts",
]
