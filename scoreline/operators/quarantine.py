"""Tolerant import of dated rows: good rows go on, bad ones are kept with the reason.

A strict cast stops the whole import at one malformed date, a tolerant one loses the row's story. Here one pass
over the rows parses the date, names what is wrong with it, and writes good and bad rows side by side (a
partition each); the report reads the first, whoever mends the data the second.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreline.session import checkpoint_dir

REASONS = ("missing", "malformed", "too early", "too late")


def parsed_date(text: str | Column) -> Column:
    """The text as a zone-free timestamp, NULL if it is none."""
    return (F.col(text) if isinstance(text, str) else text).cast("string").try_cast("timestamp_ntz")


def date_reason(text: str, not_before: str | None = None, not_after: str | None = None) -> Column:
    """Why the text in column ``text`` is no good date: one of ``REASONS``, NULL if it is good.

    Blank text is missing. The bounds are dates, both included.
    """
    raw, ts = F.col(text).cast("string"), parsed_date(text)
    reason = F.when(raw.isNull() | (F.trim(raw) == ""), "missing").when(ts.isNull(), "malformed")
    if not_before is not None:
        reason = reason.when(ts.cast("date") < F.lit(not_before).cast("date"), "too early")
    if not_after is not None:
        reason = reason.when(ts.cast("date") > F.lit(not_after).cast("date"), "too late")
    return reason


def split_dates(rows: DataFrame, column: str = "date", out: str = "snapshot_ts", not_before: str | None = None,
                not_after: str | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows by the text date in ``column``, from one pass over ``rows``.

    ``good`` has the columns of ``rows`` and ``out``, the parsed timestamp; ``bad`` has the columns of ``rows`` as they
    came and ``reason``. Both are written under ``path``, a new folder (default: in the shared folder), so the
    rows are parsed once however often the two are read. Every row is in exactly one of them; an empty
    table gives two empty ones. Raises if ``rows`` has a column of one of the added names.
    """
    taken = [c for c in (out, "reason", "quarantined") if c in rows.columns]
    if taken:
        raise ValueError(f"columns {taken} are in the rows already")
    spark = rows.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/scoreline/quarantine-{uuid.uuid4().hex}"
    reason = date_reason(column, not_before, not_after)
    marked = (rows.withColumn("reason", reason).withColumn(out, F.when(F.col("reason").isNull(), parsed_date(column)))
              .withColumn("quarantined", F.col("reason").isNotNull()))
    marked.write.partitionBy("quarantined").parquet(path)
    stored = spark.read.schema(marked.schema).parquet(path)
    return (stored.where("NOT quarantined").drop("quarantined", "reason"),
            stored.where("quarantined").drop("quarantined", out))


def quarantine_counts(bad: DataFrame, id_column: str) -> DataFrame:
    """What lies in quarantine: (reason, n, first_id, last_id) per reason."""
    return (bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min(id_column).alias("first_id"), F.max(id_column).alias("last_id"))
            .orderBy("reason"))
