"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

The token budget goes down a domain -> language -> source tree. At every node it is shared among the
children by weight, no child above its capacity (the tokens below it times ``max_epochs``), and what a
child cannot take goes to its siblings; a whole node that is short gives its shortage to its own
siblings, one level up. With capacities summed upwards that is one weighted water-filling per
level, in closed form with window sums over the (small) table of tree nodes.

A leaf with budget T and A tokens takes every document T div A times, and of the next epoch, in an order
seeded per epoch, the prefix that covers T mod A tokens. The prefix is found without a window over
the leaf: token sums per (leaf, first 12 bits of the order key) and a running sum over those 4096 sums; the
one bucket that holds the boundary is divided by the next 12 bits in the same way, and only the last
bucket, a 2^24th of the leaf, gets a window.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_key

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Targets:
    """Integer weights by name and level, ``default`` for other names; a node with weight 0 gets nothing."""

    domain: dict = field(default_factory=dict)
    lang: dict = field(default_factory=dict)
    source: dict = field(default_factory=dict)
    default: int = 1

    def weight(self, level: str) -> Column:
        out = F.lit(self.default)
        for name, w in sorted(getattr(self, level).items()):
            out = F.when(F.col(level) == name, w).otherwise(out)
        return out.cast("decimal(18,0)")


def domain_of_source() -> Column:
    """The tree's first level where documents name none: the source's number modulo 3, else "other"."""
    number = F.regexp_extract("source", r"(\d+)$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), (number.cast("bigint") % 3).cast("string")))


def water_fill(nodes: DataFrame, parent: list[str], budget: Column, weight: Column, name: str) -> DataFrame:
    """``nodes`` (with ``cap``) and column ``alloc``: the parent's ``budget`` shared by weight under the caps.

    In order of cap / weight a prefix of the children is filled to its cap; the others share the rest.
    Whole tokens, rounded down.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.try_divide(F.col("cap").cast("double"), F.col("__w").cast("double")).asc_nulls_last(), name)
    big = "decimal(38,0)"
    df = nodes.withColumn("__w", weight).withColumn("__b", budget.cast(big))
    df = df.withColumn("__cap", F.when(F.col("__w") > 0, F.col("cap")).otherwise(0).cast(big))
    before = F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("__w").over(order.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("__full", (F.col("__w") == 0) | (
        F.col("__cap") * after.cast("decimal(18,0)") <= F.col("__w") * (F.col("__b") - before.cast(big)).cast("decimal(19,0)")))
    rest = F.col("__b") - F.sum(F.when(F.col("__full"), F.col("__cap")).otherwise(0)).over(by).cast(big)
    open_w = F.sum(F.when(~F.col("__full"), F.col("__w"))).over(by)
    df = df.withColumn("__rest", rest).withColumn("__open", open_w)
    share = F.expr("cast(__w * cast(__rest AS decimal(19,0)) AS decimal(37,0)) div cast(__open AS decimal(18,0))")
    return df.withColumn("alloc", F.when(F.col("__full"), F.col("__cap").cast("bigint")).otherwise(share).cast("bigint")) \
        .drop("__w", "__b", "__cap", "__full", "__rest", "__open")


def documents_table(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """(doc_id, th, domain, lang, source, tokens): one row per distinct document; null names become "none"."""
    domain = domain if domain is not None else domain_of_source()
    names = [F.coalesce(c, F.lit("none")).alias(n) for c, n in ((domain, "domain"), (F.col("lang"), "lang"), (F.col("source"), "source"))]
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select("doc_id", text_key().alias("th"), *names, tokens.alias("tokens")).where("tokens > 0").distinct()


def leaf_budgets(table: DataFrame, targets: Targets, share_pct: int, max_epochs: int) -> DataFrame:
    """(domain, lang, source, avail, alloc) from the documents' tokens; budget = share_pct % of all tokens."""
    leaves = staged(table.groupBy(*LEVELS).agg(F.sum("tokens").alias("avail")), "leaves")
    total = leaves.agg(F.coalesce(F.sum("avail"), F.lit(0)).alias("t"))
    cap = (F.col("avail") * max_epochs).alias("cap")
    domains = leaves.groupBy("domain").agg(F.sum(F.col("avail") * max_epochs).alias("cap"))
    budget = F.expr("__total div 100")
    domains = domains.withColumn("__total", total.scalar().cast("decimal(20,0)") * share_pct)
    domains = water_fill(domains, [], budget, targets.weight("domain"), "domain").select("domain", F.col("alloc").alias("db"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum(F.col("avail") * max_epochs).alias("cap")).join(domains, "domain")
    langs = water_fill(langs, ["domain"], F.col("db"), targets.weight("lang"), "lang") \
        .select("domain", "lang", F.col("alloc").alias("lb"))
    sources = leaves.select(*LEVELS, "avail", cap).join(langs, ["domain", "lang"])
    return staged(water_fill(sources, ["domain", "lang"], F.col("lb"), targets.weight("source"), "source")
                  .select(*LEVELS, "avail", "alloc"), "budgets")


def _divided(rows: DataFrame, digit: int) -> DataFrame:
    """``rows`` by the three hex digits of ``key`` from ``digit``: new ``b0`` and ``edge``.

    ``b0``: the leaf's tokens before the row's bucket (before the first bucket of ``rows``: the old ``b0``).
    ``edge``: 1 the whole bucket lies in the prefix, 0 it holds the boundary, -1 it lies beyond.
    """
    rows = rows.withColumn("bucket", F.substring("key", digit, 3))
    sums = rows.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("n"), F.first("rest").alias("r"), F.first("b0").alias("b"))
    run = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("b0", F.col("b") + F.coalesce(F.sum("n").over(run), F.lit(0)))
    edge = F.when(F.col("b0") + F.col("n") <= F.col("r"), 1).when(F.col("b0") < F.col("r"), 0).otherwise(-1)
    return rows.drop("b0", "edge").join(sums.select(*LEVELS, "bucket", "b0", edge.alias("edge")), [*LEVELS, "bucket"])


def mix(docs: DataFrame, targets: Targets, share_pct: int = 60, max_epochs: int = 2, seed: int = 42,
        domain: Column | None = None) -> DataFrame:
    """One row per selected document: (doc_id, th, domain, lang, source, tokens, epochs, take_tokens).

    ``epochs``: in how many epochs the document takes part; ``take_tokens``: its tokens over all of
    them, the last document of a leaf's prefix in part. Tokens are white-space words.
    Documents without words, null texts among them, are never selected; rows that repeat doc_id, text
    and names count once; null names form leaves called "none"; equal order keys go by text hash.
    No documents, no budget: no rows.
    """
    table = staged(documents_table(docs, domain), "documents")
    budgets = leaf_budgets(table, targets, share_pct, max_epochs)
    plan = budgets.select(*LEVELS, F.expr("alloc div avail").alias("full"), F.expr("alloc % avail").alias("rest"))
    key = F.md5(F.concat_ws("/", F.lit(seed), F.col("full") + 1, F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    rows = staged(table.join(plan.where("full > 0 OR rest > 0"), list(LEVELS)).withColumn("key", key)
                  .withColumn("b0", F.lit(0).cast("bigint")), "keyed")
    # Whole buckets need no order; what is left of a leaf after two divisions gets a window.
    first = _divided(rows, 1)
    second = _divided(staged(first.where("edge = 0"), "boundary"), 4)
    inside = first.where("edge != 0").unionByName(second.where("edge != 0"))
    inside = inside.withColumn("part", F.when(F.col("edge") == 1, F.col("tokens")).otherwise(0))
    order = Window.partitionBy(*LEVELS).orderBy("key", "th").rowsBetween(Window.unboundedPreceding, -1)
    cum = F.col("b0") + F.coalesce(F.sum("tokens").over(order), F.lit(0))
    border = second.where("edge = 0").withColumn("part", F.greatest(F.lit(0), F.least("tokens", F.col("rest") - cum)))
    out = inside.unionByName(border)
    return (out.withColumn("epochs", (F.col("full") + (F.col("part") > 0).cast("bigint")))
            .withColumn("take_tokens", F.col("full") * F.col("tokens") + F.col("part"))
            .where("epochs > 0").select("doc_id", "th", *LEVELS, "tokens", "epochs", "take_tokens"))


def apply_mix(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``docs`` rows of the selected documents, each once per epoch it takes part in (whole texts)."""
    names = chosen.select(F.col("doc_id").alias("__id"), F.col("th").alias("__key"), F.col("epochs").alias("__n")) \
        .groupBy("__id", "__key").agg(F.max("__n").alias("__n"))
    joined = docs.withColumn("__th", text_key()).join(
        names, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__key")))
    return joined.withColumn("__e", F.explode(F.expr("sequence(1, __n)"))).select(*[F.col(f"`{c}`") for c in docs.columns])
