"""The seven-table football data model (matches, dimensions, snapshots).

For users who hold the original kind of data: matches between a home and an
away team with a score, dimension tables for country / league / team /
player, and dated attribute snapshots for players and teams. Every operator
in ``scoreline.operators`` takes these column names.

The snapshot tables carry their date as text; it is converted in one place
(``parse_snapshot_dates``) with a strict cast that raises on malformed text,
or with ``try_cast`` semantics (NULL) when ``strict=False``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

I, L, S = IntegerType(), LongType(), StringType()


def _schema(*cols) -> StructType:
    return StructType([StructField(name, typ, True) for name, typ in cols])


SCHEMAS: dict[str, StructType] = {
    "country": _schema(("id", L), ("name", S)),
    "league": _schema(("id", L), ("country_id", L), ("name", S)),
    "team": _schema(("id", L), ("team_api_id", L), ("team_long_name", S), ("team_short_name", S)),
    "player": _schema(("id", L), ("player_api_id", L), ("player_name", S)),
    "match": _schema(("id", L), ("country_id", L), ("league_id", L), ("season", S),
                     ("stage", L), ("date", S), ("match_api_id", L),
                     ("home_team_api_id", L), ("away_team_api_id", L),
                     ("home_team_goal", L), ("away_team_goal", L)),
    "player_attributes": _schema(("id", L), ("player_api_id", L), ("date", S),
                                 ("overall_rating", L), ("potential", L), ("finishing", L),
                                 ("dribbling", L), ("ball_control", L), ("sprint_speed", L),
                                 ("strength", L), ("heading_accuracy", L)),
    "team_attributes": _schema(("id", L), ("team_api_id", L), ("date", S),
                               ("buildUpPlaySpeed", L), ("buildUpPlayPassing", L),
                               ("chanceCreationPassing", L), ("chanceCreationShooting", L),
                               ("defencePressure", L), ("defenceAggression", L),
                               ("defenceTeamWidth", L)),
}


@dataclass(frozen=True)
class FootballTables:
    country: DataFrame
    league: DataFrame
    team: DataFrame
    player: DataFrame
    match: DataFrame
    player_attributes: DataFrame
    team_attributes: DataFrame


def read_football(spark: SparkSession, path: str, fmt: str = "parquet",
                  options: dict | None = None) -> FootballTables:
    """Read the seven tables from ``{path}/{table}`` in ``fmt`` (parquet, csv, json, orc),
    or with ``fmt="jdbc"`` from tables of that name in the database of
    ``options["url"]`` (``path`` unused; the JDBC driver jar must be on the
    classpath). JDBC tables are read in parallel only if ``options`` carry
    ``partitionColumn``/``lowerBound``/``upperBound``/``numPartitions``.

    Column names are matched case-insensitively (Spark's default), so
    exports that lower-case the tactical columns read the same.
    """
    frames = {}
    for name, schema in SCHEMAS.items():
        reader = spark.read.format(fmt)
        for k, v in (options or {}).items():
            reader = reader.option(k, v)
        if fmt == "jdbc":
            # JDBC takes no user schema: read, then project to the declared types.
            raw = reader.option("dbtable", name).load()
            frames[name] = raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name)
                                        for f in schema.fields])
        else:
            frames[name] = reader.schema(schema).load(f"{path.rstrip('/')}/{name}")
    return FootballTables(**frames)


def parse_snapshot_dates(snapshots: DataFrame, column: str = "date", strict: bool = True,
                         out: str = "snapshot_ts") -> DataFrame:
    """Add ``out``: the text date cast to a zone-free timestamp.

    ``strict=True`` raises on malformed text (ANSI cast); ``strict=False``
    yields NULL for it.
    """
    text = F.col(column).cast("string")
    ts = text.cast("timestamp_ntz") if strict else F.try_to_timestamp(text)
    if not strict:
        ts = ts.cast("timestamp_ntz")
    return snapshots.withColumn(out, ts)
