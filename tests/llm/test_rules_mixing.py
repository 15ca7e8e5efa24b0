from collections import Counter

from brute import docs

from scoreline.llm import mixing, quality_rules as qr


def test_measures_against_plain_python(spark):
    texts = [None, "", " \t\n", "one two", "a b c a b c", "x x x x", "# $ word|s <b>\n# $ word|s <b>\n\n \nend", "é\x0bü\x0cß\x85z",
             "w " * 40000, "a b a b a", "\n".join(["same line here"] * 5)]
    got = {r.doc_id: r for r in qr.measures(docs(spark, texts, host=["x"] * len(texts), n=["y"] * len(texts))).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        import re
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(words[j:j + 3]) for j in range(len(words) - 2)]
        many = Counter(grams)
        cover = {j + k for j, g in enumerate(grams) if many[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want


def test_a_bad_host_goes_as_a_whole(spark):
    good, bad = " ".join(f"word{i}" for i in range(80)), "too short"
    rows = [(i, good if i % 20 else bad, f"h{i % 4}") for i in range(200)] + [(1000 + i, bad, "farm") for i in range(60)]
    rows += [(2000, good, "farm"), (2001, good, None), (2002, bad, "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in qr.judge(df).collect()}
    assert not got[2000].kept and got[2000].host_rejected and not got[2000].base_failed
    assert got[2001].kept and got[1].kept and not got[0].kept and not got[0].host_rejected
    assert qr.judge(df.limit(0)).count() == 0


def _fill(budget, caps, weights):
    """Water-filling by repeated sharing."""
    left, out, open_ = budget, {}, {k for k in caps if weights[k] > 0}
    while open_:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if caps[k] * total <= weights[k] * left}
        if not full:
            return out | {k: weights[k] * left // total for k in open_} | {k: 0 for k in caps if weights[k] == 0}
        for k in full:
            out[k] = caps[k]
            left -= caps[k]
        open_ -= full
    return out | {k: 0 for k in caps if weights[k] == 0}


def test_budgets_and_prefixes(spark):
    rows = []
    for i in range(400):
        src, lang = ("src0" if i % 3 == 0 else f"src{i % 7}"), ("en" if i % 2 else "de")
        rows.append((i, "w " * (1 + i % 13), lang, src))
    rows += [(400, None, "en", "src1"), (401, "", None, None), (402, "some words", None, None), (402, "some words", None, None),
             (None, "no id", "fr", "plain")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = mixing.Targets(domain={"domain0": 9, "domain1": 0}, lang={"en": 3}, source={"src3": 5})
    table = mixing.documents_table(df)
    budgets = {(r.domain, r.lang, r.source): r for r in mixing.leaf_budgets(table, targets, 70, 2).collect()}
    caps = {k: 2 * r.avail for k, r in budgets.items()}
    weight = lambda level, name: getattr(targets, level).get(name, 1)
    sums = lambda n, pre: {k[n]: sum(c for q, c in caps.items() if q[:n + 1] == k[:n + 1]) for k in caps if k[:n] == pre}
    total = sum(r.avail for r in budgets.values()) * 70 // 100
    want = {}
    for d, db in _fill(total, c := sums(0, ()), {k: weight("domain", k) for k in c}).items():
        for lg, lb in _fill(db, c := sums(1, (d,)), {k: weight("lang", k) for k in c}).items():
            for s, b in _fill(lb, c := sums(2, (d, lg)), {k: weight("source", k) for k in c}).items():
                want[d, lg, s] = b
    assert {k: r.alloc for k, r in budgets.items()} == want
    got = mixing.mix(df, targets, 70, 2).collect()
    taken = Counter()
    for r in got:
        taken[r.domain, r.lang, r.source] += r.take_tokens
        assert 0 < r.take_tokens <= 2 * r.tokens and r.epochs in (1, 2)
    assert {k: v for k, v in taken.items()} == {k: v for k, v in want.items() if v}
    again = mixing.mix(df.repartition(7), targets, 70, 2).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = mixing.apply_mix(df.withColumn("epochs", mixing.F.lit("clash")), mixing.mix(df, targets, 70, 2))
    assert out.columns == [*df.columns, "epochs"] and out.count() >= sum(r.epochs for r in got)
    assert mixing.mix(df.limit(0), targets).count() == 0
