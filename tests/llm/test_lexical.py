"""Lexical search against a plain word count."""

import math
import random
import re
from collections import Counter

import pytest

from scoreline.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n, length = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in wanted.items():
        scored = []
        for doc, c in counts:
            m = 50 + 50 * sum(c.values()) * n // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def got(df, items, **options):
    return sorted((tuple(r) for r in lexical.rank(df, items, **options).collect()), key=str)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "of", "ab", "abc", "bc", "x1", "é", "Ünder", "naïve", "中文", "a", "b", "zz", "ß", "İ"]
    gaps = [" ", "  ", "\n", "-", ".", "\x00", "_", "\t", "'"]
    return [(i, "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 30)))) for i in range(n)]


def test_scan_counts_whole_words_only():
    scan = lexical.TermScan(["ab", "abc", "b", "the", "é"])
    assert scan.count("ab abc ab,AB the-the the") == (7, {0: 3, 1: 1, 3: 3})
    assert scan.count("éé é É") == (3, {4: 1})
    assert scan.count(None) == scan.count("") == scan.count(" \x00.,") == (0, {})
    assert scan.count("b" * 100_000 + " b") == (2, {2: 1})


def test_against_a_plain_count(spark, monkeypatch):
    docs, items = corpus(200), corpus(25, seed=2)
    docs += docs[:20] + [(None, "the zz abc"), (None, None), (900, None), (901, ""), (902, "中文 " * 30_000)]
    items += [(3, "zz extra"), (50, None), (51, "!"), (None, "the"), (52, "never-seen")] + items[:2]
    left = spark.createDataFrame([(*d, "en", 3) for d in docs], DOCS + ", term string, rank int").repartition(6)  # clashing names
    right = spark.createDataFrame([(*i, 1.0) for i in items], ITEMS + ", score double")
    want = plain(docs, items, 7)
    assert got(left, right, k=7) == want
    monkeypatch.setattr(lexical, "AT_ONCE", 64)
    assert got(left, right, k=7, most_pairs=30) == want  # several automata, scores in small pieces


def test_ties_empty_tables_and_absent_terms(spark):
    docs = [(i, "same words here") for i in range(30, 0, -1)] + [(40, "other"), (41, "things"), (42, "besides")] * 20
    left, right = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, "words"), (2, "nothing")], ITEMS)
    found = got(left, right, k=5)
    assert found == plain(docs, [(1, "words"), (2, "nothing")], 5)
    assert [r[2] for r in sorted(found, key=lambda r: r[1])] == [1, 2, 3, 4, 5]
    assert got(left.limit(0), right) == [] and got(left, right.limit(0)) == []
    assert got(spark.createDataFrame([(1, None), (2, "...")], DOCS), right) == []


@pytest.mark.parametrize("n,df", [(1, 1), (1000, 1), (1000, 1000), (10 ** 9, 3)])
def test_weight(n, df):
    assert lexical.weight(n, df) == math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) >= 0
