"""Plain-Python forms of the operators, for small inputs."""

from __future__ import annotations

import xxhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **columns):
    """documents with ids 0, 1, ... and the given texts; further (clashing) columns by keyword."""
    rows = [(i, t, "en", f"src{i % 3}", len(t) if t is not None else None, *(c[i] for c in columns.values()))
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC + "".join(f", {k} string" for k in columns))


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fingerprint(text: str | None, k: int = 3) -> int:
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n: int, linked) -> list[int]:
    """Smallest reachable index of each of 0 .. n - 1."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
