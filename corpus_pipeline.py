"""The corpus pipeline: documents to packed training sequences in five stages.

Every stage is written as Parquet and read again as the next one's input, so a lost executor costs at
most a part of one stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.llm import linededup, mil, mixing, packing, simhash
from scoreline.llm.common import NO_MARKER, read
from scoreline.llm.queries import LEAST_QUALITY, TARGETS, WINDOW, tokenizer
from scoreline.session import checkpoint_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7."""
    model = mil.fit(docs, read(spark, sf_dir, "labels"))
    return mil.score(docs, model, "__score").where(F.col("__score") >= LEAST_QUALITY).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one holds; a document goes only when no text is left."""
    return linededup.dedup_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights, each as often as epochs take it."""
    return mixing.apply_mix(docs, mixing.mix(docs, TARGETS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), WINDOW)


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup), ("simhash near-dedup", simhash_dedup),
          ("mixing sources", mix_sources), ("packing", pack_sequences)]
ORACLE_SQL = None  # token ids, learned scores and edit joins are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and reread."""
    docs = read(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").option(NO_MARKER, "false").parquet(f"{base}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}")
    return docs
