"""Registered queries over the driver's tables, and their SQL oracle."""

from scoreline.plans.catalog import QUERIES
from scoreline.plans.oracle import ORACLE_SQL

__all__ = ["QUERIES", "ORACLE_SQL"]
