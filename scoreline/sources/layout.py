"""A physical layout that does the work of the indexes: buckets by team, bloom filters on the team ids.

The last step of a schema's hardening builds indexes on the keys that reports join and search by. Files have no
B-trees; what serves the same reports is where rows lie:

* ``sides``, the matches seen by each of their two teams, is bucketed by team and so is ``teams``: a report that
  groups by team or joins team names reads matching buckets together, without an exchange of the rows.
* A search for a few teams reads their buckets only (bucket pruning).
* ``matches`` carries Parquet bloom filters on both team ids, so a search by id skips every row group in which
  the id does not occur, which min/max statistics cannot tell as ids are spread over the whole range.

All operators that look at sides of matches take ``sides`` in place of the matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.operators.reshape import PARTICIPANT_FIELDS, to_participants
from scoreline.sources.match_view import MATCH_COLUMNS, MATCH_SCHEMA, MatchTables

SIDE_KEYS = ("id", "league_id", "season", "stage", "date")
TEAM_IDS = ("home_team_api_id", "away_team_api_id")


@dataclass(frozen=True)
class Layout:
    """Stored tables: ``matches`` with bloom filters, ``sides`` and ``teams`` bucketed by team."""
    matches: DataFrame
    sides: DataFrame
    teams: DataFrame
    largest_bucket: int


def write_layout(mt: MatchTables, name: str, path: str, buckets: int = 64, most_rows: int = 1 << 28) -> Layout:
    """Write the layout of ``mt`` under ``path`` (a new folder) as tables ``{name}_sides`` and ``{name}_teams``.

    A bucket is read by one task, so the rows of the largest one are counted first (one row per bucket leaves the
    map tasks); more than ``most_rows`` raise: then take more buckets or, if a single team has that many, stay
    with the stored match table, whose reports split a hot team. Rows of NULL teams are left out of ``sides``, as every
    report by team does. Empty tables give empty tables.
    """
    spark = mt.matches.sparkSession
    path = path.rstrip("/")
    sides = to_participants(mt.matches, keep=SIDE_KEYS).where(F.col("team_api_id").isNotNull())
    bucket = F.pmod(F.hash("team_api_id"), F.lit(buckets))  # the hash that bucketing uses
    largest = sides.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most_rows:
        raise ValueError(f"a bucket of {largest} rows: choose more than {buckets} buckets, or keep the stored matches for a hot team")
    (sides.repartition(buckets, "team_api_id").write.option("path", f"{path}/sides").bucketBy(buckets, "team_api_id")
     .sortBy("team_api_id", "date", "id").saveAsTable(f"{name}_sides"))
    (mt.teams.repartition(buckets, "team_api_id").write.option("path", f"{path}/teams").bucketBy(buckets, "team_api_id")
     .sortBy("team_api_id").saveAsTable(f"{name}_teams"))
    ordered = mt.matches.hint("rebalance", "season", "league_id").sortWithinPartitions("season", "league_id", "date", "id")
    writer = ordered.write.partitionBy("season")
    for c in TEAM_IDS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.enable.dictionary#{c}", "false")
    writer.parquet(f"{path}/matches")
    matches = spark.read.schema(MATCH_SCHEMA).parquet(f"{path}/matches").select(*MATCH_COLUMNS)
    return Layout(matches, spark.table(f"{name}_sides").select(*SIDE_KEYS, *PARTICIPANT_FIELDS), spark.table(f"{name}_teams"), largest)


def drop_layout(spark: SparkSession, name: str) -> None:
    """Forget the tables of a layout; their files stay and go with their folder."""
    for part in ("sides", "teams"):
        spark.sql(f"DROP TABLE IF EXISTS `{name}_{part}`")
