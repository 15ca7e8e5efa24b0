"""Integer vectors shared by the exact vector searches: quantised rows and their classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import classes_of
from .common import staged

FITS = 2 ** 53  # integers below it are exact in a double, and so are their sums in any order


def quantised(vectors: DataFrame, scale: int, more: tuple = (), embedding: str = "embedding") -> DataFrame:
    """(vec_id, q, *more): distinct rows with an id and a vector of finite components, each floor(scale * x).

    ``more`` are columns that must not be null either. Components are doubles before they are scaled; floors
    beyond a long saturate. Vectors shorter than the longest one are continued with zeros, which leaves
    every inner product as it is; empty and zero vectors take part.
    """
    names = ("vec_id", embedding, *more)
    ok = F.expr(f"forall(`{embedding}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    rows = vectors.where(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in names)) & ok)
    q = F.transform(F.col(embedding).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    rows = staged(rows.select("vec_id", q.alias("q"), *more), "integers")
    least, most = rows.agg(F.min(F.size("q")), F.max(F.size("q"))).first()
    if least != most or most == 0:
        rows = rows.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(max(most or 0, 1)) - F.size("q"))))
    return rows.distinct()


def integer_classes(rows: DataFrame, by: list, keep: int) -> DataFrame:
    """(cid, *by, ids): one row per distinct ``by`` with its ``keep`` smallest vec_ids, ascending.

    Rows that agree in ``by`` have the same score against anything, so a top k needs no more of them.
    """
    out = classes_of(rows.select("vec_id", F.struct(*by).alias("e")), keep)
    return out.select("cid", *(F.col(f"e.{c}").alias(c) for c in by), "ids")


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows of an int64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def longest(x: np.ndarray) -> float:
    """An upper bound of the length of every row of ``x``."""
    return float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0))) * (1 + 1e-9) + 1e-9


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``a`` and ``b``; beyond a long they saturate.

    By Cauchy-Schwarz every partial sum is at most |a| |b|, so doubles are exact below 2^53.
    """
    if longest(a) * longest(b) < FITS:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return saturated(a.astype(object) @ b.T.astype(object))


def saturated(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def ragged(lists: pa.ListArray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of ``lists[at]`` in order, and for each the position in ``at`` that it comes from."""
    offsets = lists.offsets.to_numpy()
    size = np.diff(offsets)[at]
    who = np.repeat(np.arange(len(at)), size)
    inside = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size)
    return lists.values.to_numpy(zero_copy_only=False)[np.repeat(offsets[:-1][at], size) + inside], who


def best_first(row: np.ndarray, score: np.ndarray, vec_id: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the ``keep`` entries of every row with the highest scores, ties to the smaller id, in order."""
    order = np.lexsort((vec_id, ~score, row))  # ~score falls as score rises, without overflow
    row = row[order]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
    rank = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
    return order[rank < keep]
