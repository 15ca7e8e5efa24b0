"""A match-shaped view of the driver's order tables.

The operators work on matches between two participants with a score. The
driver's data is an order / line-item star schema, so matches are derived
from it, entirely on Spark:

* one match per order that has at least two distinct suppliers;
* the two sides are the lowest and the highest supplier of the order — the
  lowest plays at home on even order keys, the highest on odd ones;
* home goals = line items with return flag 'A', away goals = flag 'R';
* league = the customer's nation, country = that nation's region,
  season = the order year as text, stage (round) = the order month,
  date = the order date.

Dimensions: team = supplier, league = nation, country = region.

Plan: line items are aggregated per order (partial aggregation before the
shuffle, so even an order holding a third of all line items costs one row
per map task), joined to orders on the key the aggregate is already
partitioned by, then to customers (sort-merge or, when AQE sees it small at
runtime, broadcast), and finally to nations. No join carries a hint.
"""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (IntegerType, LongType, StringType, StructField, StructType,
                               TimestampNTZType)

from scoreline.session import checkpoint_dir
from scoreline.sources.tables import read_table

# (application, sf_dir) -> path of the match table written by this application.
_WRITTEN: dict[tuple[str, str], str] = {}
_STATES: dict[tuple[str, str], str] = {}
_WRITE_LOCK = threading.Lock()

MATCH_SCHEMA = StructType([
    StructField("id", LongType()), StructField("country_id", IntegerType()),
    StructField("league_id", IntegerType()), StructField("season", StringType()),
    StructField("stage", IntegerType()), StructField("date", TimestampNTZType()),
    StructField("home_team_api_id", LongType()), StructField("away_team_api_id", LongType()),
    StructField("home_team_goal", IntegerType()), StructField("away_team_goal", IntegerType()),
])
MATCH_COLUMNS = MATCH_SCHEMA.fieldNames()


@dataclass(frozen=True)
class MatchTables:
    """Matches plus the dimensions they reference (football column names)."""
    matches: DataFrame
    teams: DataFrame      # team_api_id, team_long_name
    leagues: DataFrame    # id, country_id, name
    countries: DataFrame  # id, name


def derive_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match rows as a lazy plan over line items, orders, customers, nations."""
    lineitem = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation")

    per_order = (
        lineitem.groupBy("l_orderkey")
        .agg(F.min("l_suppkey").alias("low_supp"),
             F.max("l_suppkey").alias("high_supp"),
             F.count_if(F.col("l_returnflag") == "A").cast("int").alias("goals_a"),
             F.count_if(F.col("l_returnflag") == "R").cast("int").alias("goals_r"))
        .filter(F.col("low_supp") != F.col("high_supp"))
    )
    even = (F.col("o_orderkey") % 2) == 0
    matches = (
        per_order
        .join(orders.select("o_orderkey", "o_custkey", "o_orderdate"),
              F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer.select("c_custkey", "c_nationkey"),
              F.col("o_custkey") == F.col("c_custkey"))
        .join(nation.select("n_nationkey", "n_regionkey"),
              F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("id"),
            F.col("n_regionkey").alias("country_id"),
            F.col("c_nationkey").alias("league_id"),
            F.year("o_orderdate").cast("string").alias("season"),
            F.month("o_orderdate").alias("stage"),
            F.col("o_orderdate").alias("date"),
            F.when(even, F.col("low_supp")).otherwise(F.col("high_supp")).alias("home_team_api_id"),
            F.when(even, F.col("high_supp")).otherwise(F.col("low_supp")).alias("away_team_api_id"),
            F.col("goals_a").alias("home_team_goal"),
            F.col("goals_r").alias("away_team_goal"),
        )
    )
    return matches


SOURCES = ("lineitem", "orders", "customer", "nation")


def source_state(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the files that the match table is derived from, as one digest."""
    files = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/{t}.parquet")
             .select("path", "length", "modificationTime") for t in SOURCES]
    digests = reduce(DataFrame.union, files).select(F.sha2(F.concat_ws("|", "path", "length", "modificationTime"), 256).alias("d"))
    # Sum of 15 hex digits of every file's digest: independent of the order, one row whatever their number.
    row = digests.agg(F.count("*"), F.sum(F.conv(F.substring("d", 1, 15), 16, 10).cast("decimal(38,0)"))).first()
    return f"{row[0]}-{row[1]}"


def _committed(spark: SparkSession, path: str) -> str | None:
    """The source state noted beside a completed write of ``path``; None if there is none."""
    try:
        spark.read.text(f"{path.rstrip('/')}/_SUCCESS").limit(1).collect()
        return spark.read.text(f"{path.rstrip('/')}.source").first()[0]
    except AnalysisException:
        return None


def _write_matches(spark: SparkSession, sf_dir: str, path: str) -> None:
    # REBALANCE lets AQE size the write tasks to the advisory partition size:
    # small (season, league) groups are coalesced, a hot one is split across
    # tasks, so the folder gets few, evenly sized files instead of one file
    # per upstream task and season.
    (derive_matches(spark, sf_dir)
     .hint("rebalance", "season", "league_id")
     .sortWithinPartitions("season", "league_id", "date", "id")
     .write.mode("overwrite").partitionBy("season").parquet(path))


def known_state(spark: SparkSession, sf_dir: str, refresh: bool = False) -> str:
    """``source_state``, looked up once per application and folder; ``refresh`` lists the files again."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if refresh or key not in _STATES:
        _STATES[key] = source_state(spark, sf_dir)
    return _STATES[key]


def stored_matches(spark: SparkSession, sf_dir: str, path: str | None = None, refresh: bool = False) -> DataFrame:
    """The match table, derived once per session and written as Parquet.

    Like the import step of a warehouse: every report then reads a stored
    fact table (column pruning, filter pushdown, partition pruning on
    ``season``) instead of re-deriving it from line items. The table goes to
    a fresh folder under the shared ``spark.checkpoint.dir`` — lineage is
    cut there, so a lost executor costs a re-read, not a re-derivation.
    Rows are rebalanced on (season, league) before the write and sorted by
    (season, league, date, id) within each task, so files are few, evenly
    sized and clustered by league (tight min/max statistics for league
    filters); AQE splits a hot (season, league) rather than giving it to one
    task.

    With ``path`` (a persistent shared location chosen by the caller), the
    table is written there once and reused by later applications while the
    source files are the ones it was derived from; a note beside it says so.
    Other or changed sources raise: the table is never served for them and
    never overwritten under its readers. The source files are listed once per application;
    ``refresh`` lists them again and derives the table anew if they changed.
    """
    state = known_state(spark, sf_dir, refresh)
    if path is not None:
        noted = _committed(spark, path)
        if noted is None:
            _write_matches(spark, sf_dir, path)
            spark.createDataFrame([(state,)], "s string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}.source")
        elif noted != state:
            raise ValueError(f"{path} was written from other source files; choose a new path")
    else:
        key = (spark.sparkContext.applicationId, sf_dir, state)
        path = _WRITTEN.get(key)
        if path is None:
            path = f"{checkpoint_dir(spark).rstrip('/')}/scoreline/matches-{uuid.uuid4().hex}"
            _write_matches(spark, sf_dir, path)
            with _WRITE_LOCK:  # two threads may both have written; the first one's table is kept
                path = _WRITTEN.setdefault(key, path)
    # The declared schema keeps the partition column ``season`` a string.
    return spark.read.schema(MATCH_SCHEMA).parquet(path).select(*MATCH_COLUMNS)


def match_tables(spark: SparkSession, sf_dir: str, stored: bool = True, refresh: bool = False) -> MatchTables:
    """Matches (stored once per session unless ``stored=False``; ``refresh`` looks for changed sources) and dimensions."""
    matches = stored_matches(spark, sf_dir, refresh=refresh) if stored else derive_matches(spark, sf_dir)
    supplier = read_table(spark, sf_dir, "supplier")
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    teams = supplier.select(F.col("s_suppkey").alias("team_api_id"),
                            F.col("s_name").alias("team_long_name"))
    leagues = nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("country_id"),
                            F.col("n_name").alias("name"))
    countries = region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return MatchTables(matches, teams, leagues, countries)


def teams_in_good_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with a non-negative account balance, as a team dimension.

    Used as the parent table of the integrity operators: matches involving
    any other supplier are orphans with respect to it.
    """
    return (read_table(spark, sf_dir, "supplier")
            .filter(F.col("s_acctbal") >= 0)
            .select(F.col("s_suppkey").alias("team_api_id"),
                    F.col("s_name").alias("team_long_name")))
