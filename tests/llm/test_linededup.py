import random

import numpy as np
from brute import classes, docs, edits

from scoreline.llm import linededup as ld


def _codes(s):
    return np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)


def _change(rng, s, k):
    s = list(s)
    for _ in range(k):
        i, kind = rng.randrange(len(s) + 1), rng.random()
        if kind < 0.4:
            s.insert(i, rng.choice("abc "))
        elif s and kind < 0.7:
            s.pop(min(i, len(s) - 1))
        elif s:
            s[min(i, len(s) - 1)] = rng.choice("abc ")
    return "".join(s)


def test_banded_distance_equals_dynamic_program():
    rng = random.Random(3)
    pairs = []
    for _ in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(40)))
        pairs.append((a, _change(rng, a, rng.randrange(7))))
    for most in (1, 2, 3, 5):
        got = ld.edit_distances([_codes(a) for a, _ in pairs], [_codes(b) for _, b in pairs], most)
        assert got.tolist() == [min(edits(a, b), most + 1) for a, b in pairs]


def _removed(texts, threshold, least):
    lines = [(d, i, x) for d, t in enumerate(texts) for i, x in enumerate((t or "").split("\n")) if len(x) >= least]
    group = classes(len(lines), lambda i, j: abs(len(lines[i][2]) - len(lines[j][2])) <= threshold
                    and edits(lines[i][2], lines[j][2]) <= threshold)
    out = {d: [] for d in range(len(texts))}
    for k, (d, i, _) in enumerate(lines):
        if group[k] != k:
            out[d].append((i, lines[group[k]][0]))
    return out


def _texts():
    rng = random.Random(11)
    line = lambda: "".join(rng.choice("abcdef ") for _ in range(rng.randint(10, 60)))
    pool = [line() for _ in range(25)]
    out = []
    for _ in range(40):
        rows = [_change(rng, rng.choice(pool), rng.randrange(4)) if rng.random() < 0.6 else line() for _ in range(rng.randint(1, 5))]
        out.append("\n".join(rows))
    return [*out, None, "", "\n\n", "tiny\ntiny", out[0], "x" * 500, "x" * 501 + "\n" + "é" * 30]


def test_removed_lines_equal_brute_force(spark, monkeypatch):
    texts = _texts()
    df = docs(spark, texts, removed=["clash"] * len(texts), id=["clash"] * len(texts))
    want = _removed(texts, 2, 20)
    for hot in (1000, 2):  # salting of hot hashes changes nothing
        monkeypatch.setattr(ld, "HOT", hot)
        got = {r.doc_id: list(zip(r.removed, r.classes)) for r in ld.duplicate_lines(df).collect()}
        assert got == want
    small = ld.links(df, block=1)  # nor do small blocks
    from scoreline.llm.graph import components
    assert {tuple(r) for r in components(small).collect()} == {tuple(r) for r in components(ld.links(df)).collect()}


def test_texts_after_dedup(spark):
    a, b, c = ("first line of some length", "second line of some length", "third line, a different one")
    df = docs(spark, [f"{a}\n{b}", f"{a}\n{b}\nown line that nobody else has, long enough", f"{a}\n{b}", None, "", c],
              __th=["x"] * 6)
    df = df.drop("__th").union(df.drop("__th").where("doc_id = 5"))
    got = {(r.doc_id, r.text, r.n_chars) for r in ld.dedup_lines(df, least_kept=0.4).collect()}
    own = "own line that nobody else has, long enough"
    assert got == {(0, f"{a}\n{b}", 52), (1, own, len(own)), (3, None, None), (4, "", 0), (5, c, len(c))}
    assert ld.dedup_lines(df).count() == 5 + 0 or ld.dedup_lines(df).columns == df.columns
    assert ld.dedup_lines(df.limit(0)).count() == 0 and ld.duplicate_lines(df.limit(0)).count() == 0


def test_null_ids(spark):
    line = "one and the same line in both texts"
    df = docs(spark, [line, line]).selectExpr("if(doc_id = 1, null, doc_id) AS doc_id", "text")
    got = {r.doc_id: r.n_removed for r in ld.duplicate_lines(df).collect()}
    assert got == {None: 0, 0: 1}  # null ids come first


def test_batches_of_long_lines_are_bounded(monkeypatch):
    """Long lines are compared a few at a time, with the same distances."""
    rng = np.random.default_rng(3)
    line = rng.integers(97, 123, 2_000).astype(np.uint32)
    copies = []
    for _ in range(12):
        c = line.copy()
        c[rng.integers(0, len(c), 2)] += 1
        copies.append(c)
    short = [rng.integers(97, 100, int(n)).astype(np.uint32) for n in rng.integers(1, 9, 12)]
    a = [x for x in copies for _ in copies] + [x for x in short for _ in short]
    b = copies * len(copies) + short * len(short)
    want = ld.edit_distances(a, b, 4)
    sizes = []
    real = ld._band
    monkeypatch.setattr(ld, "_band", lambda P, T, *rest: sizes.append(P.size) or real(P, T, *rest))
    monkeypatch.setattr(ld, "CELLS", 20_000)
    assert (ld.edit_distances(a, b, 4) == want).all() and max(sizes) <= 20_000 and len(sizes) > 20
    assert (want[:144] <= 4).all() and want[0] == 0


def test_rows_of_a_line_that_nobody_shares():
    """A line's own segments make one row each, and a line alone has no hash that occurs twice."""
    lines = ["the first of two lines, of some length", "second line: altogether unlike it, 0123456789"]
    got = list(ld.signatures(lines, 2))
    sig = np.concatenate([s for _, s, _ in got])
    assert len(set(sig.tolist())) == len(sig) and sum(len(w) for w, _, p in got if not p) == 6


def test_line_texts_are_read_in_one_place(spark):
    """Only the wanted lines leave their documents, once each, whatever repeats."""
    text = "first line of some length\nanother one, that is wanted"
    df = docs(spark, [text, text, None, ""])
    df = df.selectExpr("if(doc_id = 0, null, doc_id) AS doc_id", "text")
    df = df.union(df.limit(1))
    first = ld.places(ld.line_table(df, 20))
    wanted = first.where(first.id == ld.line_id("another one, that is wanted"))
    assert [(bytes(r.id), r.line) for r in ld.line_texts(df, wanted).collect()] == [
        (ld.line_id("another one, that is wanted"), "another one, that is wanted")]
