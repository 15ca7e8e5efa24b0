"""Quarantine, observed clean-up, gated publication, and the layout that replaces indexes."""

import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01, plan_text
from scoreline import operators as op
from scoreline.operators.publish import current_version
from scoreline.sources import drop_layout, match_tables, teams_in_good_standing, write_layout
from scoreline.sources.match_view import derive_matches
from scoreline.streaming import match_stream, read_live_table, start_live_table

DATES = [(1, "2020-01-01 00:00:00"), (2, None), (3, "  "), (4, "soon"), (5, "2020-13-01"), (6, "1880-05-05"), (7, "2999-01-01"),
         (8, "2020-02-30 00:00:00"), (9, "2020-02-29"), (9, "2020-02-29"), (10, "x" * 50_000), (11, "")]


def test_split_dates(spark):
    rows = spark.createDataFrame(DATES, "id long, date string")
    good, bad = op.split_dates(rows, not_before="1900-01-01", not_after="2100-01-01")
    assert [(r.id, str(r.snapshot_ts)[:10]) for r in good.orderBy("id").collect()] == [(1, "2020-01-01"), (9, "2020-02-29"), (9, "2020-02-29")]
    assert {r.id: r.reason for r in bad.collect()} == {2: "missing", 3: "missing", 11: "missing", 4: "malformed", 5: "malformed", 8: "malformed",
                                                       10: "malformed", 6: "too early", 7: "too late"}
    assert {r.id: r.date for r in bad.collect()}[10] == "x" * 50_000  # kept as it came
    assert good.columns == ["id", "date", "snapshot_ts"] and bad.columns == ["id", "date", "reason"]
    assert [tuple(r) for r in op.quarantine_counts(bad, "id").collect()] == [
        ("malformed", 4, 4, 10), ("missing", 3, 2, 11), ("too early", 1, 6, 6), ("too late", 1, 7, 7)]
    assert "quarantined" in plan_text(good) and "PartitionFilters" in plan_text(good)  # bad rows are not even read
    unbound = op.split_dates(rows)[1]
    assert unbound.count() == 7
    with pytest.raises(ValueError, match="reason"):
        op.split_dates(rows.withColumn("reason", F.lit(1)))
    assert [x.count() for x in op.split_dates(rows.limit(0))] == [0, 0]


def test_counts_are_taken_while_writing(spark, tmp_path):
    mt, good = match_tables(spark, SF01), teams_in_good_standing(spark, SF01)
    refs = [("home_team_api_id", good, "team_api_id"), ("away_team_api_id", good, "team_api_id")]
    kept, counts = op.write_clean(mt.matches, refs, str(tmp_path / "clean"))
    plain = op.drop_orphans(mt.matches, refs)
    assert counts == {"before": mt.matches.count(), "removed": mt.matches.count() - plain.count(), "kept": plain.count()} and counts["removed"] > 0
    assert kept.exceptAll(plain).count() == 0 and kept.columns == mt.matches.columns
    report = op.integrity_report([("match", mt.matches, plain)], [("id", mt.matches, ["id"])], [], [])
    assert {r.kind: r.violations for r in report.collect()}["clean"] == counts["removed"]
    assert op.write_clean(mt.matches.limit(0), refs, str(tmp_path / "none"))[1] == {"before": 0, "removed": 0, "kept": 0}
    assert op.write_clean(mt.matches, [], str(tmp_path / "all"))[1]["removed"] == 0


def test_a_violation_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    parent = spark.createDataFrame([(1,), (2,)], "k long")
    old = spark.createDataFrame([(1, 1), (2, 2), (3, 9)], "id long, fk long")
    keys = {"primary_keys": [("pk", ["id"])], "foreign_keys": [("fk", "fk", parent, "k")]}
    with pytest.raises(FileNotFoundError):
        op.read_published(spark, path)
    done = op.publish(old, path, refs=[("fk", parent, "k")], **keys)  # the orphan is cleaned away
    assert done.counts == {"before": 3, "removed": 1, "kept": 2} and all(r.violations == 0 for r in done.report)
    assert current_version(spark, path) == done.version
    seen = op.read_published(spark, path)
    for bad, name in ((spark.createDataFrame([(1, 1), (1, 2)], "id long, fk long"), "pk"), (old, "fk"),
                      (spark.createDataFrame([(None, 1)], "id long, fk long"), "pk")):
        with pytest.raises(ValueError, match=f"key {name}"):
            op.publish(bad, path, **keys)
        assert current_version(spark, path) == done.version
        assert sorted(r.id for r in op.read_published(spark, path).collect()) == sorted(r.id for r in seen.collect()) == [1, 2]
    assert sorted(os.listdir(path)) == sorted([done.version, "_current"] + [f for f in os.listdir(path) if f.endswith(".crc")])
    new = op.publish(spark.createDataFrame([(7, 2)], "id long, fk long"), path, **keys)
    assert [r.id for r in op.read_published(spark, path).collect()] == [7] and new.version != done.version
    assert seen.count() == 2  # a reader that began before goes on
    assert op.publish(old.limit(0), path, **keys).counts["kept"] == 0
    with pytest.raises(ValueError, match="nothing to check"):
        op.publish(old, path)


def test_a_stream_stops_before_it_shows_a_bad_version(spark):
    source, table, ckpt = (tempfile.mkdtemp(prefix="scoreline-audit-") for _ in range(3))
    matches = derive_matches(spark, SF001)
    matches.where("season < '1998'").write.mode("append").parquet(source)
    known = matches.select("team_api_id") if "team_api_id" in matches.columns else match_tables(spark, SF001).teams.select("team_api_id")

    def audit(written):
        return op.integrity_report([], [("season table", written, ["team_api_id", "league_id", "season"])], [],
                                   [("fk_team", written, "team_api_id", known, "team_api_id")])

    def run():
        q = start_live_table(match_stream(spark, source), "audit_test", sink="table", path=f"{table}/t", checkpoint=ckpt, audit=audit)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    run()
    before = read_live_table(spark, f"{table}/t")
    rows = before.count()
    assert rows > 0 and os.listdir(f"{table}/t") == ["version=0"]
    matches.where("season >= '1998'").withColumn("home_team_api_id", F.lit(-5).cast("long")).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="fk_team"):
        run()
    assert read_live_table(spark, f"{table}/t").count() == rows


@pytest.fixture(scope="module")
def layout(spark, tmp_path_factory):
    mt = match_tables(spark, SF001)
    path = str(tmp_path_factory.mktemp("layout"))
    yield mt, write_layout(mt, "layout_test", path, buckets=8), path
    drop_layout(spark, "layout_test")


def _no_broadcast(spark, build):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan_text(build(), "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_teams_are_joined_and_grouped_without_an_exchange(spark, layout):
    mt, stored, _ = layout
    plan = _no_broadcast(spark, lambda: op.top_winners(stored.sides, stored.teams, mt.leagues, 1, 10))
    assert "hashpartitioning(team_api_id" not in plan and "hashpartitioning(_t_id" not in plan and "Bucketed: true" in plan
    plain = _no_broadcast(spark, lambda: op.top_winners(mt.matches, mt.teams, mt.leagues, 1, 10))
    assert "hashpartitioning(team_api_id" in plain and plain.count("Exchange") > plan.count("Exchange")
    want, got = (op.top_winners(m, t, mt.leagues, 1, 10) for m, t in ((mt.matches, mt.teams), (stored.sides, stored.teams)))
    assert [tuple(r) for r in want.collect()] == [tuple(r) for r in got.collect()]
    season = _no_broadcast(spark, lambda: op.season_table(stored.sides))
    assert "Exchange" not in season


def test_a_team_is_found_in_its_bucket(spark, layout):
    _, stored, _ = layout
    one = stored.sides.where("team_api_id = 3")
    # Files of other buckets are skipped in any case; the plan says so where the scan is by buckets.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        assert "SelectedBucketsCount: 1 out of 8" in plan_text(one)
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert one.count() == stored.sides.where("team_api_id + 0 = 3").count() > 0


def test_ids_reach_the_files_and_have_bloom_filters(spark, layout):
    mt, stored, path = layout
    names = [r.team_long_name for r in mt.teams.orderBy("team_api_id").limit(2).collect()]
    ids = op.team_ids(mt.teams, *names)
    plan = plan_text(op.head_to_head(stored.matches, stored.teams, *names, ids=ids))
    assert re.search(r"PushedFilters: \[[^\n]*In\(home_team_api_id", plan) and re.search(r"In\(away_team_api_id", plan)
    same = [op.head_to_head(m, t, *names, ids=i) for m, t, i in ((mt.matches, mt.teams, None), (stored.matches, stored.teams, ids))]
    assert [tuple(r) for r in same[0].collect()] == [tuple(r) for r in same[1].collect()]
    assert op.head_to_head(stored.matches, stored.teams, "nobody", "no one", ids=op.team_ids(mt.teams, "nobody")).count() == 0
    with pytest.raises(ValueError, match="more than 1"):
        op.team_ids(mt.teams, *names, most=1)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = next(d for d in sorted(os.listdir(f"{path}/matches")) if d.startswith("season="))
    part = next(f for f in os.listdir(f"{path}/matches/{folder}") if f.endswith(".parquet"))
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f"{path}/matches/{folder}/{part}"), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    try:
        columns = {c.getPath().toDotString(): c.getBloomFilterOffset() for c in reader.getFooter().getBlocks().get(0).getColumns()}
    finally:
        reader.close()
    assert columns["home_team_api_id"] > 0 and columns["away_team_api_id"] > 0 and columns["league_id"] <= 0


def test_a_hot_bucket_is_refused(spark, layout, tmp_path):
    mt, _, _ = layout
    with pytest.raises(ValueError, match="hot team"):
        write_layout(mt, "layout_hot", str(tmp_path / "hot"), buckets=2, most_rows=10)
    empty = write_layout(type(mt)(mt.matches.limit(0), mt.teams, mt.leagues, mt.countries), "layout_none", str(tmp_path / "none"), buckets=2)
    assert empty.sides.count() == empty.matches.count() == empty.largest_bucket == 0
    drop_layout(spark, "layout_none")
