"""Data-integrity operators: orphan removal, key checks, foreign-key checks.

Constraints are not enforced by a store here; they are checked by jobs
that return the violating keys (empty result = constraint holds), and
orphan removal is a keep-filter that returns a new DataFrame.

Orphan removal follows ``DELETE FROM child WHERE fk NOT IN (SELECT pk FROM
parent) [OR fk2 NOT IN (...)]`` exactly, including SQL's three-valued
logic: a row is deleted only when the predicate is TRUE. Per key that means

* parent empty                         -> every row is deleted;
* fk NULL, parent not empty            -> kept (NOT IN gives NULL);
* fk matches a parent key              -> kept;
* no match but the parent has a NULL   -> kept (NOT IN gives NULL);
* otherwise                            -> deleted.

A rewrite as ``NOT (fk NOT IN ...)`` would drop the NULL-key rows, and the
OR of two NOT IN subqueries plans as nested-loop existence joins. Here each
key is one equi-join against the distinct non-NULL parent keys (a hash or
sort-merge join, broadcast only when AQE measures the key set small), and
the parent's row count and NULL count are one scalar subquery.

Constraint checks share one plan: every table is read once, each of its rows
becomes one (constraint, key) row per constraint, parents add their keys with
a mark, and a single partial aggregation per key type counts child rows and
finds the mark. No check needs a join, and a key held by a third of the rows
leaves each map task as one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def _flagged(child: DataFrame, refs: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """``child`` with ``_keep``: does the row survive the orphan DELETE over all ``refs`` = (fk, parent, pk)."""
    out = child
    safe: list[Column] = [F.lit(True)]
    for i, (fk, parent, pk) in enumerate(refs):
        keys = (parent.select(F.col(pk).alias(f"_pk{i}")).filter(F.col(f"_pk{i}").isNotNull())
                .distinct().withColumn(f"_hit{i}", F.lit(True)))
        rows = parent.select(F.struct(F.count(F.lit(1)).alias("n"),
                                      F.count_if(F.col(pk).isNull()).alias("nulls"))).scalar()
        out = out.join(keys, F.col(fk) == F.col(f"_pk{i}"), "left")
        safe.append((rows.getField("n") > 0) &
                    (F.col(fk).isNull() | F.col(f"_hit{i}").isNotNull() | (rows.getField("nulls") > 0)))
    helpers = [c for i in range(len(refs)) for c in (f"_pk{i}", f"_hit{i}")]
    return out.withColumn("_keep", reduce(lambda a, b: a & b, safe)).drop(*helpers)


def drop_orphans(child: DataFrame, refs: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """Rows of ``child`` that survive the orphan DELETE over all ``refs`` = (fk, parent, pk)."""
    return _flagged(child, refs).filter("_keep").drop("_keep")


def write_clean(child: DataFrame, refs: Sequence[tuple[str, DataFrame, str]], path: str) -> tuple[DataFrame, dict]:
    """Write what ``drop_orphans`` keeps to ``path`` (a new folder); returns the written table and the step's counts.

    The counts {"before", "removed", "kept"} are observed on the rows as they are written, so neither table is read
    again for them. They are taken in the writing tasks themselves, after all exchanges: a task that runs
    again after a lost executor counts once. Empty tables count 0.
    """
    spark, seen = child.sparkSession, Observation()
    one = F.lit(1)
    flagged = _flagged(child, refs).observe(seen, F.count(one).alias("before"), F.count_if(F.col("_keep")).alias("kept"))
    flagged.filter("_keep").drop("_keep").write.parquet(path)
    counts = {k: seen.get[k] or 0 for k in ("before", "kept")}
    return (spark.read.schema(child.schema).parquet(path),
            {"before": counts["before"], "removed": counts["before"] - counts["kept"], "kept": counts["kept"]})


def clean_counts(spark: SparkSession, steps: Sequence[tuple[str, dict]]) -> DataFrame:
    """The counts of some ``write_clean`` steps as rows (constraint_name, before, removed, kept); one per step."""
    return spark.createDataFrame([(name, c["before"], c["removed"], c["kept"]) for name, c in steps],
                                 "constraint_name string, before long, removed long, kept long")


def check_unique(df: DataFrame, cols: Sequence[str], primary: bool = True) -> DataFrame:
    """Key values that break a PRIMARY KEY (``primary=True``) or UNIQUE constraint.

    Output: the key columns and ``n`` (rows holding that key). A primary key
    also reports keys with a NULL part; a UNIQUE constraint allows any number
    of rows with a NULL part. Partial aggregation collapses a hot key map-side.
    """
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    if primary:
        return counted.filter((F.col("n") > 1) | any_null)
    return counted.filter((F.col("n") > 1) & ~any_null)


def _key_types(df: DataFrame, cols: Sequence[str]) -> tuple[str, ...]:
    """Types of a key's columns; all integer types count as bigint."""
    types = [df.schema[c].dataType for c in cols]
    return tuple("bigint" if isinstance(t, IntegralType) else t.simpleString() for t in types)


def _key_counts(entries: Sequence[tuple[int, DataFrame, Sequence[str], bool]],
                types: tuple[str, ...]) -> DataFrame:
    """(tag, k0.., n, has_parent) per tag and key from ``entries`` = (tag, table, key columns, is_parent).

    ``n`` counts the child rows. Each table is read once, however many entries name
    it; an entry without key columns counts rows under a NULL key.
    """
    tables: dict[int, tuple[DataFrame, list[Column]]] = {}
    for tag, df, cols, is_parent in entries:
        values = [F.col(c) for c in cols] or [F.lit(None)] * len(types)
        keys = [v.cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(values, types))]
        row = F.struct(F.lit(tag).alias("tag"), F.lit(is_parent).alias("is_parent"), *keys)
        tables.setdefault(id(df), (df, []))[1].append(row)
    tagged = reduce(DataFrame.union, [df.select(F.inline(F.array(*rows))) for df, rows in tables.values()])
    return (tagged.groupBy("tag", *[f"k{i}" for i in range(len(types))])
            .agg(F.count_if(~F.col("is_parent")).alias("n"), F.max("is_parent").alias("has_parent")))


def _foreign_entries(tag: int, name: str, child: DataFrame, fk: str, parent: DataFrame, pk: str):
    """Key types and the two entries of a foreign key; types that differ raise, as in DDL."""
    types = _key_types(child, [fk])
    if types != _key_types(parent, [pk]):
        raise TypeError(f"{name}: {fk} and {pk} have different types")
    return types, [(tag, child, [fk], False), (tag, parent, [pk], True)]


def _orphaned() -> Column:
    return (F.col("n") > 0) & ~F.col("has_parent") & F.col("k0").isNotNull()


def check_fk(child: DataFrame, fk: str, parent: DataFrame, pk: str,
             constraint: str | None = None) -> DataFrame:
    """Foreign-key values of ``child`` with no parent: (constraint_name, fk_value, n_rows).

    A NULL foreign key passes, and a NULL parent key matches nothing.
    """
    return check_fks([(constraint or f"{fk} -> {pk}", child, fk, parent, pk)])


def check_fks(checks: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Several foreign keys at once: ``checks`` = (constraint, child, fk, parent, pk)."""
    groups: dict[tuple[str, ...], list] = {}
    for tag, (name, child, fk, parent, pk) in enumerate(checks):
        types, entries = _foreign_entries(tag, name, child, fk, parent, pk)
        groups.setdefault(types, []).extend(entries)
    names = F.array(*[F.lit(c[0]) for c in checks])
    parts = [_key_counts(entries, types).filter(_orphaned())
             .select(names[F.col("tag")].alias("constraint_name"), F.col("k0").cast("string").alias("fk_value"),
                     F.col("n").alias("n_rows")) for types, entries in groups.items()]
    return reduce(DataFrame.union, parts)


def integrity_report(clean: Sequence[tuple[str, DataFrame, DataFrame]],
                     primary_keys: Sequence[tuple[str, DataFrame, Sequence[str]]],
                     unique_keys: Sequence[tuple[str, DataFrame, Sequence[str]]],
                     foreign_keys: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """The schema-hardening sequence as one report, in its order of steps:
    1 orphan clean-up (rows removed), 2 primary keys, 3 unique keys,
    4 foreign keys (checked on the cleaned tables the caller passes).

    ``clean`` = (name, before, after). Output: step, kind, constraint_name, violations;
    a constraint that holds has a row with 0. Passing the same DataFrame object to
    several checks reads it once per key type. Empty tables violate nothing.
    """
    checks: list[tuple[int, str, str]] = []   # step, kind, name; the tag is the position
    groups: dict[tuple[str, ...], list] = {}
    for step, kind, specs in ((2, "primary key", primary_keys), (3, "unique", unique_keys)):
        for name, df, cols in specs:
            groups.setdefault(_key_types(df, cols), []).append((len(checks), df, list(cols), False))
            checks.append((step, kind, name))
    for name, *foreign in foreign_keys:
        types, entries = _foreign_entries(len(checks), name, *foreign)
        groups.setdefault(types, []).extend(entries)
        checks.append((4, "foreign key", name))
    for name, before, after in clean:
        for kind, df in (("clean", before), ("kept", after)):
            # Counted in a pass that reads the table anyway, if there is one.
            home = next((t for t, entries in groups.items() if any(e[1] is df for e in entries)), ("bigint",))
            groups.setdefault(home, []).append((len(checks), df, [], False))
            checks.append((1, kind, name))

    def tags(kind: str) -> Column:
        return F.col("tag").isin([i for i, c in enumerate(checks) if c[1] == kind])

    parts = []
    for types, entries in groups.items():
        no_null = reduce(lambda a, b: a & b, [F.col(f"k{i}").isNotNull() for i in range(len(types))])
        one = F.lit(1).cast("long")
        found = (F.when(tags("clean"), F.col("n")).when(tags("kept"), -F.col("n"))
                 .when(tags("primary key") & ((F.col("n") > 1) | ~no_null), one)
                 .when(tags("unique") & (F.col("n") > 1) & no_null, one)
                 .when(tags("foreign key") & _orphaned(), F.col("n")))
        parts.append(_key_counts(entries, types).select("tag", found.alias("v")).filter("v IS NOT NULL"))
    if not checks:
        raise ValueError("nothing to check")
    # "kept" rows lower the count of the clean-up right before them; every check starts from 0.
    report = [i - 1 if c[1] == "kept" else i for i, c in enumerate(checks)]
    spark = next(iter(groups.values()))[0][1].sparkSession
    parts.append(spark.range(len(checks)).select(F.col("id").cast("int").alias("tag"), F.lit(0).cast("long").alias("v")))
    row = F.array(*[F.struct(F.lit(step).alias("step"), F.lit("clean" if kind == "kept" else kind).alias("kind"),
                             F.lit(name).alias("constraint_name")) for step, kind, name in checks])
    return (reduce(DataFrame.union, parts)
            .groupBy(F.array(*[F.lit(i) for i in report])[F.col("tag")].alias("tag")).agg(F.sum("v").alias("violations"))
            .select(row[F.col("tag")].alias("r"), "violations").select("r.*", "violations"))


def enforce(report: DataFrame) -> DataFrame:
    """Fail like ``ADD CONSTRAINT`` would: raise if any key or foreign-key check
    of an ``integrity_report`` has violations; otherwise return the report.

    The report has one row per constraint, so collecting it is bounded.
    """
    bad = [(r.kind, r.constraint_name, r.violations) for r in
           report.filter((F.col("kind") != "clean") & (F.col("violations") > 0)).collect()]
    if bad:
        lines = ", ".join(f"{kind} {name}: {n}" for kind, name, n in bad)
        raise ValueError(f"constraint violations — {lines}")
    return report
