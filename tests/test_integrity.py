"""Orphan removal against SQL NOT IN semantics (DuckDB as oracle), key and FK checks."""

import duckdb
import pandas as pd
import pytest

from scoreline import operators as op

CHILD = [(1, 10, 20), (2, 10, 30), (3, None, 20), (4, 30, None), (5, 40, 40), (6, 20, 10)]
PARENTS = {"normal": [10, 20], "with_null": [10, None], "empty": []}


def _duck_keep(parent_keys, two_keys: bool):
    con = duckdb.connect()
    con.register("child", pd.DataFrame(CHILD, columns=["id", "a", "b"]).astype({"a": "Int64", "b": "Int64"}))
    con.register("parent", pd.DataFrame({"k": pd.array(parent_keys, dtype="Int64")}))
    pred = "a NOT IN (SELECT k FROM parent)"
    if two_keys:
        pred += " OR b NOT IN (SELECT k FROM parent)"
    return sorted(r[0] for r in con.execute(
        f"SELECT id FROM child WHERE NOT coalesce({pred}, false)").fetchall())


@pytest.mark.parametrize("parent", list(PARENTS))
@pytest.mark.parametrize("two_keys", [False, True])
def test_drop_orphans_matches_not_in(spark, parent, two_keys):
    child = spark.createDataFrame(CHILD, "id long, a long, b long")
    par = spark.createDataFrame([(k,) for k in PARENTS[parent]], "k long")
    refs = [("a", par, "k")] + ([("b", par, "k")] if two_keys else [])
    got = sorted(r.id for r in op.drop_orphans(child, refs).collect())
    assert got == _duck_keep(PARENTS[parent], two_keys)
    assert op.drop_orphans(child, refs).columns == ["id", "a", "b"]


def test_drop_orphans_expected_counts(spark):
    child = spark.createDataFrame(CHILD, "id long, a long, b long")
    counts = []
    for parent in ("normal", "with_null", "empty"):
        par = spark.createDataFrame([(k,) for k in PARENTS[parent]], "k long")
        counts.append(op.drop_orphans(child, [("a", par, "k")]).count())
    assert counts == [4, 6, 0]   # NULL key kept; a NULL parent key keeps all; empty parent keeps none


def test_check_unique_primary_and_unique(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (None, None), (None, None), (3, "z")],
                               "k long, name string")
    pk = sorted((r.k, r.n) for r in op.check_unique(df, ["k"], primary=True).collect()
                if r.k is not None)
    assert pk == [(1, 2)]
    assert [r.n for r in op.check_unique(df, ["k"], primary=True).collect() if r.k is None] == [2]
    assert op.check_unique(df, ["name"], primary=False).count() == 0   # several NULLs allowed


def test_check_fk_null_passes_unknown_reported(spark):
    child = spark.createDataFrame([(1, 10), (2, None), (3, 99), (4, 99)], "id long, fk long")
    parent = spark.createDataFrame([(10,), (20,)], "pk long")
    rows = op.check_fk(child, "fk", parent, "pk", "fk_test").collect()
    assert [(r.constraint_name, r.fk_value, r.n_rows) for r in rows] == [("fk_test", "99", 2)]


def test_integrity_report_steps(spark):
    child = spark.createDataFrame(CHILD, "id long, a long, b long")
    par = spark.createDataFrame([(10,), (20,)], "k long")
    kept = op.drop_orphans(child, [("a", par, "k"), ("b", par, "k")])
    rep = op.integrity_report(clean=[("child orphans", child, kept)],
                              primary_keys=[("child.id", kept, ["id"])],
                              unique_keys=[("parent.k", par, ["k"])],
                              foreign_keys=[("fk_a", kept, "a", par, "k"), ("fk_b", kept, "b", par, "k")])
    got = {(r.step, r.constraint_name): r.violations for r in rep.collect()}
    assert got == {(1, "child orphans"): 6 - len(_duck_keep([10, 20], True)), (2, "child.id"): 0,
                   (3, "parent.k"): 0, (4, "fk_a"): 0, (4, "fk_b"): 0}


def test_enforce_raises_on_violations(spark):
    child = spark.createDataFrame(CHILD, "id long, a long, b long")
    par = spark.createDataFrame([(10,), (20,)], "k long")
    rep = op.integrity_report(clean=[], primary_keys=[("child.id", child, ["id"])], unique_keys=[],
                              foreign_keys=[("fk_a", child, "a", par, "k")])
    with pytest.raises(ValueError, match="fk_a: 2"):
        op.enforce(rep)
    kept = op.drop_orphans(child, [("a", par, "k")])
    ok = op.integrity_report(clean=[], primary_keys=[], unique_keys=[],
                             foreign_keys=[("fk_a", kept, "a", par, "k")])
    assert op.enforce(ok) is ok


def test_integrity_report_counts_every_kind(spark):
    child = spark.createDataFrame([(1, 10, "x"), (1, 30, "x"), (None, 30, None), (2, None, None)], "id int, fk int, name string")
    par = spark.createDataFrame([(10, 1), (None, 2)], "k long, v long")
    rep = op.integrity_report(clean=[("all", child, child.filter("id = 1")), ("none", par, par)],
                              primary_keys=[("child.id", child, ["id"]), ("child.id_name", child, ["id", "name"])],
                              unique_keys=[("child.name", child, ["name"]), ("child.fk", child, ["fk"])],
                              foreign_keys=[("fk", child, "fk", par, "k")])
    got = {(r.step, r.kind, r.constraint_name): r.violations for r in rep.collect()}
    assert got == {(1, "clean", "all"): 2, (1, "clean", "none"): 0, (2, "primary key", "child.id"): 2,
                   (2, "primary key", "child.id_name"): 3, (3, "unique", "child.name"): 1,
                   (3, "unique", "child.fk"): 1, (4, "foreign key", "fk"): 2}
    with pytest.raises(TypeError, match="different types"):
        op.check_fk(child, "name", par, "k")


def test_integrity_of_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, fk long")
    par = spark.createDataFrame([], "k long")
    rep = op.integrity_report(clean=[("c", empty, empty)], primary_keys=[("pk", empty, ["id"])],
                              unique_keys=[], foreign_keys=[("fk", empty, "fk", par, "k")])
    assert {r.constraint_name: r.violations for r in rep.collect()} == {"c": 0, "pk": 0, "fk": 0}
