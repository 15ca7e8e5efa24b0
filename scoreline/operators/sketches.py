"""Distinct counts from mergeable sketches.

An exact distinct count over many seasons has to see every (group, team) pair again each time. Here the teams of
every league and season are kept as one HyperLogLog sketch of a few KB (Spark's DataSketches aggregates, combined
map-side); any coarser count — a country, a decade, everything — is a union of stored sketches and never reads a
match. New matches are merged into the stored sketches, not counted again.

A sketch of 2^k registers errs by about 1.04 / sqrt(2^k) (one standard deviation, after unions); small sets are
counted exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRECISION = 12  # 2^12 registers: a standard error of 1.6 %


def standard_error(precision: int = PRECISION) -> float:
    """The relative standard error of a merged sketch."""
    return 1.04 / 2 ** (precision / 2)


def team_sketches(matches: DataFrame, precision: int = PRECISION) -> DataFrame:
    """(league_id, season, matches, teams): the home teams of every league and season as a sketch.

    NULL team ids are not counted; a league-season without any has an empty sketch.
    """
    return (matches.groupBy("league_id", "season")
            .agg(F.count(F.lit(1)).alias("matches"), F.hll_sketch_agg(F.col("home_team_api_id").cast("long"), precision).alias("teams")))


def merge_sketches(parts: Sequence[DataFrame], by: Sequence[str] = ("league_id", "season")) -> DataFrame:
    """Sketch tables merged into one row per ``by``: matches add up, sketches unite.

    With the default key this brings stored sketches up to date with those of new matches; fewer keys roll up.
    """
    return (reduce(DataFrame.unionByName, parts).groupBy(*by)
            .agg(F.sum("matches").alias("matches"), F.hll_union_agg("teams").alias("teams")))


def write_sketches(sketches: DataFrame, path: str) -> None:
    """Store a sketch table at ``path`` (a new folder); a row is a few KB, so tables stay small."""
    sketches.write.parquet(path)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("league_id long, season string, matches long, teams binary").parquet(path)


def approx_teams(sketches: DataFrame, leagues: DataFrame, countries: DataFrame) -> DataFrame:
    """Per country: matches, seasons and about how many home teams, from stored sketches alone."""
    lg = leagues.select(F.col("id").alias("_l_id"), F.col("country_id").alias("_l_cid"))
    ct = countries.select(F.col("id").alias("_c_id"), F.col("name").alias("country"))
    named = sketches.join(lg, F.col("league_id") == F.col("_l_id")).join(ct, F.col("_l_cid") == F.col("_c_id"))
    return (named.groupBy("country")
            .agg(F.sum("matches").alias("matches"), F.countDistinct("season").alias("seasons"),
                 F.hll_sketch_estimate(F.hll_union_agg("teams")).alias("approx_teams"))
            .orderBy(F.col("country").asc_nulls_last()))


def audit_teams(sketches: DataFrame, matches: DataFrame, leagues: DataFrame, countries: DataFrame,
                precision: int = PRECISION, sigmas: float = 4.0) -> DataFrame:
    """``approx_teams`` beside the exact count, with whether the estimate keeps its error bound of ``sigmas``.

    The exact count reads the matches; it is what the stored sketches spare. A country has a row if it has matches.
    """
    lg = leagues.select(F.col("id").alias("_l_id"), F.col("country_id").alias("_l_cid"))
    ct = countries.select(F.col("id").alias("_c_id"), F.col("name").alias("_country"))
    pairs = matches.groupBy("league_id", "home_team_api_id").agg(F.lit(1).alias("_one"))
    exact = (pairs.join(lg, F.col("league_id") == F.col("_l_id")).join(ct, F.col("_l_cid") == F.col("_c_id"))
             .groupBy("_country").agg(F.countDistinct("home_team_api_id").alias("exact_teams")))
    bound = F.greatest(F.lit(1.0), F.lit(sigmas * standard_error(precision)) * F.col("exact_teams"))
    return (approx_teams(sketches, leagues, countries).join(exact, F.col("country").eqNullSafe(F.col("_country")))
            .select("country", "matches", "seasons", "exact_teams", (F.abs(F.col("approx_teams") - F.col("exact_teams")) <= bound).alias("within_bound"))
            .orderBy(F.col("country").asc_nulls_last()))
