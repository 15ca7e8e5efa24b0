"""Quality rules on documents and on their hosts (DataFrame functions only).

Every text is measured in its own row by array functions, so a long text costs no shuffle. Failures of
four rules are summed per host (map-side partial sums: a host with a third of all rows is one row per
task). Each rule's failure rate is shrunk with a beta prior that is fitted to all hosts by moments;
a host whose shrunk rate of any rule passes ``limit`` is rejected with all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, staged

SYMBOLS = r"[#*$%&|<>]"
RULES = ("short", "repeats", "symbols", "dup_lines")


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every whole text.

    Null or empty text: all zero. A word is a run of characters other than ASCII white space.
    n_repeat_words: words in three-word windows that occur twice or more, windows compared by a
    64-bit hash within the text.
    """
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", F.col(host).alias("host"), text.alias("t"))
    df = df.select("doc_id", "host", "t", F.expr(rf"filter(split(t, r'{SPACE}'), w -> w != '')").alias("w"),
                   F.expr(rf"filter(split(t, '\n'), x -> x RLIKE r'[^\x20\x09-\x0D]')").alias("lines"))
    df = df.select("doc_id", "host", "w", F.size("w").alias("n"), F.length(F.array_join("w", "")).alias("word_chars"),
                   F.regexp_count("t", F.lit(SYMBOLS)).alias("n_symbols"),
                   (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"))
    grams = "transform(slice(w, 1, greatest(n - 2, 0)), (x, i) -> struct(xxhash64(x, w[i + 1], w[i + 2]) AS h, i AS p))"
    df = df.withColumn("g", F.expr(f"sort_array({grams})")).drop("w")
    twice = "filter(g, (x, i) -> x.h = if(i > 0, g[i - 1].h, NULL) OR x.h = if(i + 1 < size(g), g[i + 1].h, NULL))"
    df = df.withColumn("d", F.expr(f"transform({twice}, x -> x.p)")).drop("g")
    covered = F.array_distinct(F.expr("flatten(array(d, transform(d, p -> p + 1), transform(d, p -> p + 2)))"))
    return df.select("doc_id", "host", F.col("n").cast("long").alias("n_words"),
                     F.col("word_chars").cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"),
                     F.col("n_dup_lines").cast("long").alias("n_dup_lines"), F.size(covered).cast("long").alias("n_repeat_words"))


def failures() -> dict[str, Column]:
    """The rules, on the columns of :func:`measures`."""
    return {
        "short": F.col("n_words") < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "dup_lines": 3 * F.col("n_dup_lines") > F.col("n_words"),
    }


def host_verdicts(measured: DataFrame, limit: float = 0.5) -> DataFrame:
    """(host, docs, short, repeats, symbols, dup_lines, rejected): counts, shrunk rates and the verdict.

    Beta prior per rule by moments over the hosts' raw rates: mean m and variance v give the strength
    s = m (1 - m) / v - 1, held between 1 and 1e6 (1e6 where v is 0). Shrunk rate: (failures + m s)
    / (documents + s). Documents without a host form one host of their own (null).
    """
    counts = staged(measured.groupBy("host").agg(
        F.count("*").alias("docs"), *[F.sum(c.cast("long")).alias(r) for r, c in failures().items()]), "hosts")
    rate = {r: F.col(r) / F.col("docs") for r in RULES}
    prior = counts.agg(F.struct(*[F.avg(rate[r]).alias(f"m_{r}") for r in RULES],
                                *[F.var_pop(rate[r]).alias(f"v_{r}") for r in RULES]).alias("p"))
    out = counts.withColumn("p", prior.scalar())  # one row, computed once

    def shrunk(rule: str) -> Column:
        m, v = F.col(f"p.m_{rule}"), F.col(f"p.v_{rule}")
        s = F.when(v > 0, F.greatest(F.lit(1.0), F.least(F.lit(1e6), m * (1 - m) / v - 1))).otherwise(1e6)
        return (F.col(rule) + m * s) / (F.col("docs") + s)
    rates = out.select("host", "docs", *[shrunk(r).alias(r) for r in RULES])
    return rates.withColumn("rejected", F.greatest(*RULES) > limit)


def judge(docs: DataFrame, host: str = "source", limit: float = 0.5) -> DataFrame:
    """(doc_id, host, measures..., base_failed, host_rejected, kept) for every row of ``docs``.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated windows. ``kept``:
    neither base_failed nor on a rejected host. Repeated rows count and come back each; an empty
    table gives no rows; other columns are ignored.
    """
    measured = staged(measures(docs, host), "measures")
    bad = host_verdicts(measured, limit).where("rejected").select(F.col("host").alias("h"), F.lit(True).alias("host_rejected"))
    rule = failures()
    out = measured.join(bad, F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    out = out.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    out = out.withColumn("base_failed", rule["short"] | rule["repeats"])
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
