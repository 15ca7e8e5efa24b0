"""Helpers shared by the text operators: tables, staged tables and document keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# Fixed value: the ASCII white space that separates words in every contract of this package.
SPACE = r"[\x20\x09-\x0D]+"

NO_MARKER = "mapreduce.fileoutputcommitter.marksuccessfuljobs"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder and read it back.

    Cuts lineage: a lost executor costs a re-read, and what several later steps read is computed
    once. The folder is the one that ``spark.checkpoint.dir`` names. No ``_SUCCESS`` marker is left: nothing
    reads it, and for each one on a local file system the driver starts ``chmod`` processes, which for
    a moment count with all of its memory.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option(NO_MARKER, "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: str = "text") -> Column:
    """A 64-bit hash of the text; with ``doc_id`` it tells rows apart without a generated id.

    Rows that agree in both are the same document repeated.
    """
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))
