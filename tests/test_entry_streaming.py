"""Driver contract smoke test and the streaming season table."""

import os
import tempfile

import pytest

from conftest import SF001
from scoreline import operators as op
from scoreline.sources.match_view import derive_matches
from scoreline.streaming import live_season_table, match_stream, read_live_table, start_live_table


def test_entry_and_registry(spark):
    import __spark_entry__ as entry_mod
    df = entry_mod.entry(spark)
    assert df.columns == ["league", "season", "position", "team", "points", "won", "drawn", "lost",
                          "goals_for", "goals_against", "goal_diff"]
    assert df.count() > 0
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


def test_stream_keeps_the_season_table(spark):
    folder = tempfile.mkdtemp(prefix="scoreline-stream-")
    derive_matches(spark, SF001).repartition(4).write.mode("overwrite").parquet(folder)
    stream = match_stream(spark, folder, max_files_per_trigger=1)
    assert stream.isStreaming and live_season_table(stream).isStreaming
    q = start_live_table(stream, "live_table_test", sink="memory")
    try:
        q.processAllAvailable()
        live = spark.table("live_table_test")
        batch = op.season_table(spark.read.parquet(folder))
        assert live.exceptAll(batch).count() == 0 and batch.exceptAll(live).count() == 0
    finally:
        q.stop()


def test_stream_resumes_from_its_checkpoint(spark):
    source = tempfile.mkdtemp(prefix="scoreline-stream-src-")
    table = tempfile.mkdtemp(prefix="scoreline-stream-out-")
    ckpt = tempfile.mkdtemp(prefix="scoreline-stream-ckpt-")
    matches = derive_matches(spark, SF001)
    first, second = matches.filter("season < '1998'"), matches.filter("season >= '1998'")
    first.write.mode("append").parquet(source)
    q = start_live_table(match_stream(spark, source), "resume_test", sink="table",
                         path=f"{table}/t", checkpoint=ckpt)
    q.processAllAvailable()
    q.stop()
    second.write.mode("append").parquet(source)          # more matches arrive while stopped
    q = start_live_table(match_stream(spark, source), "resume_test", sink="table",
                         path=f"{table}/t", checkpoint=ckpt)
    q.processAllAvailable()
    q.stop()
    live = read_live_table(spark, f"{table}/t")
    batch = op.season_table(spark.read.parquet(source))
    assert live.exceptAll(batch).count() == 0 and batch.exceptAll(live).count() == 0


def test_readers_meet_complete_versions_only(spark):
    source = tempfile.mkdtemp(prefix="scoreline-stream-src-")
    table = tempfile.mkdtemp(prefix="scoreline-stream-out-") + "/t"
    with pytest.raises(FileNotFoundError):
        read_live_table(spark, table)
    derive_matches(spark, SF001).repartition(5).write.mode("append").parquet(source)
    q = start_live_table(match_stream(spark, source, max_files_per_trigger=1), "versions_test", sink="table",
                         path=table, checkpoint=tempfile.mkdtemp(prefix="scoreline-stream-ckpt-"))
    q.processAllAvailable()
    q.stop()
    assert sorted(os.listdir(table)) == ["version=2", "version=3", "version=4"]
    whole = read_live_table(spark, table)
    assert whole.exceptAll(op.season_table(spark.read.parquet(source))).count() == 0
    os.remove(f"{table}/version=4/_SUCCESS")   # as if the last batch were still being written
    assert read_live_table(spark, table).count() <= whole.count()
    assert "version=3" in read_live_table(spark, table).inputFiles()[0]
