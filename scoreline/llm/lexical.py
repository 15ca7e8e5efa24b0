"""Ranked lexical search by an Aho-Corasick scan of the documents.

The terms of all items form one automaton, every term guarded by a blank on both sides. A text is folded so
that each delimiter becomes a blank, then one pass of the automaton counts the occurrences of all
terms at once; its outputs map to the items that hold the term. No index of the documents exists:
they are scanned once for the corpus figures (documents, terms, documents per term) and once more to
score, and a task returns only its figures or its best documents per item.

The automaton is broadcast, so its size is bounded: items are dealt to groups of about ``most_pairs``
(item, term) pairs, and each group has scans of its own. A text is scanned whole, whatever its length.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: a term is a maximal run of characters other than these ASCII delimiters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
AT_ONCE = 1 << 21  # scores held at once
NO_ID = (1 << 63) - 1


class TermScan:
    """The guarded automaton of some terms; ``count`` scans one text."""

    def __init__(self, terms: list[str]):
        self.automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            self.automaton.add_word(f" {term} ", i)
        self.automaton.make_automaton()

    def count(self, text: str | None) -> tuple[int, Counter]:
        """(number of terms of the text, occurrences by number of the term); neighbours share their blank."""
        flat = (text or "").encode("utf-8", "surrogatepass").translate(FOLD)
        found = self.automaton.iter(f" {flat.decode('utf-8', 'surrogatepass')} ")
        return len(flat.split()), Counter(map(itemgetter(1), found))


_SCANS: dict = {}


def _scan(key: str, terms: list[str]) -> TermScan:
    """The automaton of a broadcast term list, built once in a Python worker; only the last is kept."""
    if key not in _SCANS:
        _SCANS.clear()
        _SCANS[key] = TermScan(terms)
    return _SCANS[key]


def weight(n: int, df: int) -> int:
    """A term's weight among n documents of which df hold it."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class BestDocuments:
    """The best ``k`` documents per item so far, of the documents one task has seen."""

    def __init__(self, k: int, items: int):
        self.k, self.kth = k, np.ones(items, dtype=np.int64)  # scores above 0 only
        self.held = [np.empty(0, dtype=np.int64)] * 4  # item, score, no id, id
        self.news: list = []
        self.n = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.kth[None, :])
        self.news.append((item, scores[doc, item], no_id[doc], ids[doc]))
        self.n += len(doc)
        if self.n > max(4 * self.k * len(self.kth), 1 << 16):
            self.reduce()

    def reduce(self) -> None:
        item, score, no_id, ids = (np.concatenate([h, *(x[c] for x in self.news)]) for c, h in enumerate(self.held))
        order = np.lexsort((ids, no_id, ~score, item))
        of = item[order]
        start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
        rank = np.arange(len(of)) - np.repeat(start, np.diff(np.r_[start, len(of)]))
        order = order[rank < self.k]
        self.held, self.news, self.n = [x[order] for x in (item, score, no_id, ids)], [], 0
        full = np.flatnonzero(np.bincount(self.held[0], minlength=len(self.kth)) == self.k)
        self.kth[full] = self.held[1][np.searchsorted(self.held[0], full, side="right") - 1]


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of every item; items of one id are one item, null ids are left out."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(TERM), 0)
    return items.where(F.col(item).isNotNull()).select(F.col(item).alias("item_id"), F.explode(words).alias("term")).distinct()


def rank(docs: DataFrame, items: DataFrame, k: int = 50, most_pairs: int = 1 << 20, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The ``k`` highest-scoring documents of every item: (item_id, rank, doc_id, score), rank 1 first.

    Only scores above 0; equal scores by ascending doc_id, null ids last. Terms are runs of characters that
    are no ASCII delimiter, A-Z lower-cased. N counts the documents with a term, L all their terms, n one document's, df
    the documents with the term, tf its occurrences in the document. With m = 50 + (50 n N) div L and
    w = floor(1000 ln((2N + 2) / (2df + 1))) a document scores the sum of w * (10^9 tf div (1000 tf + 20 m))
    over the item's terms, once each.

    Every row of ``docs`` is a document, repeated rows too. Null and empty texts have no terms: such
    documents count nowhere, such items have no rows. No documents or no items: an empty result.
    Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    terms = item_terms(items)
    kind = terms.schema["item_id"].dataType.simpleString()
    groups = max(1, -(-2 * terms.count() // most_pairs) if most_pairs else 1)
    groups = 1 if groups == 2 else groups  # a single group up to most_pairs
    out = None
    for g in range(groups):
        part = terms if groups == 1 else terms.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g)
        pairs = part.orderBy("item_id", "term").toArrow()  # about most_pairs rows at most
        if pairs.num_rows:
            found = _search(spark, docs, pairs, kind, k)
            out = found if out is None else out.union(found)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out


def _search(spark, docs: DataFrame, pairs: pa.Table, kind: str, k: int) -> DataFrame:
    term_codes, item_codes = (pairs[c].combine_chunks().dictionary_encode() for c in ("term", "item_id"))
    terms, names = term_codes.dictionary.to_pylist(), item_codes.dictionary
    of_term, of_item = (np.asarray(c.indices).astype(np.int64) for c in (term_codes, item_codes))
    order = np.argsort(of_term, kind="stable")
    item_of = of_item[order]  # the items of each term, one term after the other
    begin = np.r_[0, np.cumsum(np.bincount(of_term, minlength=len(terms)))]
    key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast((terms, begin, item_of, names))

    def figures(batches):
        scan, df, n, length = _scan(key, sent.value[0]), np.zeros(len(sent.value[0]), dtype=np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                size, found = scan.count(text)
                n, length = n + (size > 0), length + size
                df[list(found)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(len(df)), -1, -2]), pa.array(np.r_[df, n, length])], names=["term", "n"])

    counts = docs.select("text").mapInArrow(figures, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total = dict(zip(counts["term"].to_pylist(), counts["n"].to_pylist()))  # one row per term of the automaton
    n_docs, length = total.get(-1, 0), total.get(-2, 0)
    w = spark.sparkContext.broadcast(np.array([weight(n_docs, total.get(t, 0)) for t in range(len(terms))], dtype=np.int64))

    def best(batches):
        terms, begin, item_of, names = sent.value
        scan, top, weights = _scan(key, terms), BestDocuments(k, len(names)), w.value
        size_of = np.diff(begin)
        rows = max(1, AT_ONCE // len(names))
        for batch in batches:
            ids = batch.column(0)
            no_id = np.asarray(ids.is_null())
            ids = ids.fill_null(NO_ID).to_numpy()
            for at in range(0, batch.num_rows, rows):
                here = slice(at, at + rows)
                sizes, founds = zip(*map(scan.count, batch.column(1).slice(at, rows).to_pylist()))
                hits = np.fromiter((len(f) for f in founds), dtype=np.int64, count=len(founds))
                term = np.fromiter((t for f in founds for t in f), dtype=np.int64, count=hits.sum())
                tf = np.fromiter((x for f in founds for x in f.values()), dtype=np.int64, count=hits.sum())
                m = np.repeat(np.array([50 + 50 * s * n_docs // max(length, 1) for s in sizes], dtype=np.int64), hits)
                gain = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))
                scores = np.zeros((len(founds), len(names)), dtype=np.int64)
                row = np.repeat(np.arange(len(founds)), hits)
                piece = np.cumsum(size_of[term]) // AT_ONCE if len(term) else term  # bounded expansions
                for p in np.split(np.arange(len(term)), np.flatnonzero(np.diff(piece)) + 1) if len(term) else []:
                    wide = size_of[term[p]]
                    inside = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
                    item = item_of[np.repeat(begin[term[p]], wide) + inside]
                    np.add.at(scores.reshape(-1), np.repeat(row[p] * len(names), wide) + item, np.repeat(gain[p], wide))
                top.add(scores, ids[here], no_id[here])
        top.reduce()
        item, score, no_id, ids = top.held
        if len(item):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(item)), pa.array(ids, mask=no_id.astype(bool)), pa.array(score)],
                                             names=["item_id", "doc_id", "score"])

    found = docs.mapInArrow(best, f"item_id {kind}, doc_id long, score long")
    # A task holds at most k documents an item; many tasks' are cut per salt first, then per item.
    for salts in (64, 1):
        salt = [F.pmod(F.xxhash64("doc_id"), F.lit(salts))] if salts > 1 else []
        order = Window.partitionBy("item_id", *salt).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
    return found
