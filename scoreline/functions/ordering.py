"""Sort keys with SQL's NULL placement.

Spark sorts NULL first in ascending order; SQL (and the oracle) sorts it
last. Tie-breakers of top-k reports use these so that the k rows kept are
the same ones a SQL engine keeps.

Names compare byte by byte unless a collation is given: databases usually sort
by a language's rules, where "Élan" stands beside "Elan" and not after "Zürich".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_asc(*cols: str | Column) -> list[Column]:
    """Ascending, NULLs last."""
    return [(F.col(c) if isinstance(c, str) else c).asc_nulls_last() for c in cols]


def collated(col: str | Column, collation: str | None) -> Column:
    """``col`` compared by a Spark collation ("UNICODE", "UNICODE_CI_AI", "de", ...); unchanged without one.

    The value keeps its text; what changes is how it sorts, groups and joins.
    """
    c = F.col(col) if isinstance(col, str) else col
    return c if collation is None else F.collate(c, collation)
