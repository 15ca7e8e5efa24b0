from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from scoreline.session import checkpoint_dir, get_session  # noqa: E402
from scoreline.sources.match_view import MATCH_SCHEMA  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", shuffle_partitions=4)
    checkpoint_dir(s)
    yield s


def d(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


class Fixture:
    """Small hand-written match tables."""

    def __init__(self, spark):
        self.spark = spark

    def matches(self, rows):
        """rows: (id, league_id, season, stage, 'YYYY-MM-DD', home, away, home_goals, away_goals)."""
        full = [(i, 0, lg, season, stage, d(day), h, a, hg, ag)
                for i, lg, season, stage, day, h, a, hg, ag in rows]
        return self.spark.createDataFrame(full, MATCH_SCHEMA)

    def teams(self, names: dict):
        return self.spark.createDataFrame(list(names.items()), "team_api_id long, team_long_name string")

    def leagues(self, names: dict, country: int = 0):
        return self.spark.createDataFrame([(k, country, v) for k, v in names.items()],
                                          "id int, country_id int, name string")

    def countries(self, names: dict):
        return self.spark.createDataFrame(list(names.items()), "id int, name string")


@pytest.fixture(scope="session")
def fx(spark):
    return Fixture(spark)


def plan_text(df, mode: str = "formatted") -> str:
    """The text ``df.explain(mode)`` prints."""
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()
