"""Column expressions (built-in Spark functions only, no UDFs)."""

from scoreline.functions.ordering import collated, sql_asc
from scoreline.functions.outcomes import drawn, flag, in_run, lost, points, result, won
from scoreline.functions.rounding import avg_rounded, half_up, mean, pct

__all__ = ["half_up", "pct", "mean", "avg_rounded", "result", "points", "flag",
           "won", "drawn", "lost", "in_run", "sql_asc", "collated"]
