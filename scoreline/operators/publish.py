"""Clean, check, then publish: readers see a table only after its constraints were found to hold.

A new version is written to a folder of its own, cleaned of orphans and counted in that same pass
(``integrity.write_clean``), audited as it lies there, and only then named in the pointer file that readers
follow. A violated constraint leaves the pointer, and with it the old version, as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from scoreline.operators.integrity import enforce, integrity_report, write_clean

POINTER = "_current"


@dataclass(frozen=True)
class Published:
    """What a publication did: the version's name, the counts of its clean-up and the audit's (few) rows."""
    version: str
    counts: dict
    report: list


def _filesystem(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Name ``version`` in the pointer file; the file is replaced by a rename, never seen half written."""
    jvm = spark._jvm
    root, fs = _filesystem(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(root, f".{POINTER}-{uuid.uuid4().hex}")
    stream = fs.create(draft, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), spark._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(draft), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(root, POINTER)), overwrite)


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that readers of ``path`` see; None before the first publication."""
    root, fs = _filesystem(spark, path)
    pointer = spark._jvm.org.apache.hadoop.fs.Path(root, POINTER)
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The table last published at ``path``. Raises if there is none."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing is published under {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{version}")


def publish(table: DataFrame, path: str, *, refs: Sequence[tuple[str, DataFrame, str]] = (),
            primary_keys: Sequence[tuple[str, Sequence[str]]] = (), unique_keys: Sequence[tuple[str, Sequence[str]]] = (),
            foreign_keys: Sequence[tuple[str, str, DataFrame, str]] = ()) -> Published:
    """Publish ``table`` at ``path`` if it keeps its constraints.

    ``refs`` = (fk, parent, pk) are cleaned of orphans first; ``primary_keys`` and ``unique_keys`` = (name, columns),
    ``foreign_keys`` = (name, fk, parent, pk) are checked on the version as it was written. A violation raises
    ``ValueError`` naming the constraints; the written version is then removed and readers keep the old one.
    Versions that were published before stay, for readers that have begun; the caller drops them.
    """
    if not (primary_keys or unique_keys or foreign_keys):
        raise ValueError("nothing to check")
    spark, version = table.sparkSession, f"version-{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/{version}"
    kept, counts = write_clean(table, refs, folder)
    report = integrity_report([], [(n, kept, cols) for n, cols in primary_keys], [(n, kept, cols) for n, cols in unique_keys],
                              [(n, kept, fk, parent, pk) for n, fk, parent, pk in foreign_keys])
    rows = report.collect()  # one row per constraint
    try:
        enforce(spark.createDataFrame(rows, report.schema))
    except ValueError:
        root, fs = _filesystem(spark, folder)
        fs.delete(root, True)
        raise
    _point(spark, path, version)
    return Published(version, counts, rows)
