"""A season table kept current from a directory of arriving match files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from scoreline.operators.integrity import enforce
from scoreline.operators.standings import season_table
from scoreline.session import checkpoint_dir
from scoreline.sources.match_view import MATCH_SCHEMA

KEPT_VERSIONS = 3  # complete versions of a live table that stay readable


def match_stream(spark: SparkSession, path: str, schema: StructType = MATCH_SCHEMA,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Matches as a stream of Parquet files landing under ``path``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def live_season_table(matches: DataFrame) -> DataFrame:
    """The season table (points, W/D/L, goals) of a streaming match DataFrame."""
    return season_table(matches)


def _version_path(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/version={version}"


def _versions(spark: SparkSession, path: str) -> list[tuple[int, object]]:
    """(version, folder status) of the versions under ``path``; at most a few, as old ones are dropped."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [(s.getPath().getName(), s) for s in fs.listStatus(root)]
    return sorted(((int(n.split("=")[1]), s) for n, s in found if n.startswith("version=")), key=lambda v: v[0])


def _drop_versions(spark: SparkSession, path: str, before: int) -> None:
    for version, status in _versions(spark, path):
        if version < before:
            folder = status.getPath()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _write_audited(spark: SparkSession, batch: DataFrame, path: str, version: int, audit: Callable[[DataFrame], DataFrame]) -> None:
    """Write a version out of the readers' sight, audit it there, then rename it into place."""
    hidden = f"{path.rstrip('/')}/_auditing-{version}"
    batch.write.mode("overwrite").parquet(hidden)
    enforce(audit(spark.read.schema(batch.schema).parquet(hidden)))
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (hidden, _version_path(path, version)))
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(target, True)  # of a batch that failed after its rename
    if not fs.rename(source, target):
        raise OSError(f"cannot rename {hidden}")


def read_live_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of the live table at ``path``.

    A version counts once its ``_SUCCESS`` file is there, which the write commits
    last, so a reader never meets a batch half written. Older versions stay for
    ``KEPT_VERSIONS`` batches, for readers that have already begun. Raises if no
    version is complete yet.
    """
    for version, status in reversed(_versions(spark, path)):
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            return spark.read.parquet(_version_path(path, version))
    raise FileNotFoundError(f"no complete version of the table under {path}")


def start_live_table(matches: DataFrame, name: str, sink: str = "table",
                     output_mode: str = "complete", path: str | None = None,
                     checkpoint: str | None = None,
                     audit: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Start maintaining the season table.

    Aggregation state and progress are checkpointed (default: under the
    session's shared checkpoint folder), so a restarted query — after a lost
    executor or driver — resumes from the last committed batch.

    ``sink="table"`` (the default, needs ``path``) writes the whole current table
    after every batch as a version of its own under ``path``, read with
    ``read_live_table``; with ``audit``, a function from the written table to an ``integrity_report``,
    a version becomes visible only if every constraint holds, otherwise the stream stops with the
    violations and readers keep the versions before; ``sink="memory"`` keeps it in the driver as ``name``
    (tests, notebooks); any other value is a Structured Streaming format.
    """
    spark = matches.sparkSession
    location = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    writer = (live_season_table(matches).writeStream.outputMode(output_mode)
              .option("checkpointLocation", location))
    if sink == "memory":
        return writer.format("memory").queryName(name).start()
    if sink == "table":
        if not path:
            raise ValueError("sink='table' needs a path")

        def write_version(batch: DataFrame, batch_id: int) -> None:
            if any(version > batch_id for version, _ in _versions(spark, path)):
                raise ValueError(f"{path} holds the table of another stream")
            # After a failure the batch is replayed into its own version.
            if audit is None:
                batch.write.mode("overwrite").parquet(_version_path(path, batch_id))
            else:
                _write_audited(spark, batch, path, batch_id, audit)
            _drop_versions(spark, path, before=batch_id - KEPT_VERSIONS + 1)

        return writer.foreachBatch(write_version).queryName(name).start()
    return writer.format(sink).start(path)
