"""Surrogates for personal data (DataFrame functions only).

Entities are found by one pass of one pattern over each text: it brackets every match with a mark the text
does not hold, and splitting there gives the gaps and the entities between them. The rows are written with
these pieces, so no later step searches a text again. An entity has one or more canonical values (a mail
address in lower case, the digits of a number, each part of a name), and a value's replacement depends on
a secret key, its kind and itself alone: the same person or number reads the same everywhere, however it
is spaced, capitalised or titled (coreference). Replacements keep the kind's form: letters become letters of the
same case, digits digits, separators stay; phone numbers keep their country code, cards their first digit
and a valid check digit, addresses valid octets; names keep title, gender and script.

Where a text holds a titled name, later mentions of the full name or the family name without the title are
replaced alike. Numbers of card length that fail the Luhn test are no cards and stay.

Distinctness: the distinct values of the corpus (partial aggregation; a hot value is one row per task) are checked for
two that got the same replacement, and for a replacement that is someone's real value; those move to the
next attempt until none is left. Names grow by a syllable an attempt, so their space never runs out. The few texts that
hold a value with a later attempt get it by a join; all others are rewritten in their own row.

Not covered: names without any titled mention, and scripts other than Latin and Cyrillic.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_key

# Forms of personal data. Earlier kinds win where two could match at the same place. Repeats of
# unbounded length are possessive and begin at the start of a run of such characters, so time is linear in the
# text and the matcher does not recurse.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_IP = rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
_SSN = r"\d{3}-\d{2}-\d{4}(?![0-9-])"
_CARD = r"(?:(?:\d{4}[ -]){3}\d{4}|\d{13,19})(?![0-9])"
_WORD = r"\p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)?"
_TITLES = {"f": ["Mrs", "Ms", "Frau", "Señora", "Madame", "Госпожа"], "m": ["Mr", "Herr", "Señor", "Monsieur", "Господин"], "n": ["Dr", "Prof"]}
_TITLE = "(?:" + "|".join(sorted(sum(_TITLES.values(), []), key=len, reverse=True)) + r")\.?"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{40}(?:[0-9a-f]{24})?|(?:AKIA|ASIA)[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{32,}+)(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9.])(?=\d){_IP}",
    "ssn": rf"(?<![0-9-])(?=\d){_SSN}",
    "card": rf"(?<![0-9])(?=\d){_CARD}",
    # A further group of a phone number is not the beginning of an address, card or other number beside it.
    "phone": rf"(?=[+(])(?<![0-9A-Za-z])(?:\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:(?![ .-]?(?:{_IP}|{_SSN}|{_CARD}))[ .-]?\d{{2,4}}){{1,4}}+(?![0-9])"
             r"|\(\d{3}\) ?\d{3}-\d{4}(?![0-9]))",
    "name": rf"(?<!\p{{L}}){_TITLE} {_WORD}(?: {_WORD})?",
}
_FIRST = "0-9a-fAgs+(" + "".join(sorted({t[0] for t in sum(_TITLES.values(), [])}))  # how any but a mail address begins
WITHOUT_MAIL = f"(?=[{_FIRST}])(?:" + "|".join(p for k, p in PATTERNS.items() if k != "email") + ")"
ENTITY = f"{PATTERNS['email']}|{WITHOUT_MAIL}"
# Fixed value: country calling codes are one digit (1, 7), two digits (these) or three.
_CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
MARK = "\ue000"  # a private-use character
# Given names by gender and script, and syllables that names are built from.
GIVEN = {
    ("f", "latin"): ["Anna", "Clara", "Elena", "Greta", "Irene", "Julia", "Laura", "Maria", "Nora", "Olga", "Paula", "Rosa", "Sofia", "Teresa", "Vera", "Yvonne"],
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Jonas", "Louis", "Martin", "Oscar", "Paul", "Robert", "Simon", "Victor"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Григорий", "Иван", "Максим", "Олег", "Павел"],
}
GIVEN |= {("n", s): GIVEN["f", s] + GIVEN["m", s] for s in ("latin", "cyrillic")}
SYLLABLES = {
    "latin": ["ba", "den", "ko", "lar", "min", "ner", "os", "pel", "ri", "sal", "tor", "ul", "ven", "wes", "zan", "hol"],
    "cyrillic": ["ба", "ден", "ко", "лар", "мин", "нер", "ос", "пел", "ри", "сал", "тор", "ул", "вен", "гор", "зан", "хол"],
}


def _array(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _digits(e: str) -> str:
    return f"regexp_replace({e}, '[^0-9]', '')"


def _luhn(digits: str, odd: int) -> str:
    return (f"aggregate(transform(reverse(split({digits}, '')), (c, i) -> IF(i % 2 = {odd}, int(c) * 2 - IF(int(c) > 4, 9, 0), int(c))), "
            f"0, (a, x) -> a + x)")


def kind(e: str) -> str:
    """SQL: the kind of a match ``e``; for names the title's gender ("f", "m" or "n"); NULL for a number that is no card."""
    of = {k: p for k, p in PATTERNS.items() if k != "name"}
    cases = " ".join(f"WHEN {e} RLIKE r'^(?:{p})$' THEN " + (f"IF({_luhn(_digits(e), 1)} % 10 = 0, 'card', NULL)" if k == "card" else f"'{k}'")
                     for k, p in of.items())
    titles = " ".join(f"WHEN {e} RLIKE r'^(?:{'|'.join(_TITLES[g])})[. ]' THEN '{g}'" for g in ("f", "m"))
    return f"CASE {cases} {titles} ELSE 'n' END"


def _untitled(e: str) -> str:
    return f"regexp_replace({e}, r'^{_TITLE} ', '')"


def _script(word: str) -> str:
    return f"IF({word} RLIKE r'\\p{{IsCyrillic}}', 'cyrillic', 'latin')"


def _name_value(word: str, place: str, words: str, gender: str) -> str:
    """SQL: the canonical value of one part of a name; the last of several words, or the only one, is the family name."""
    return (f"IF({place} = size({words}) - 1, concat('family|', {_script(word)}, '|', lower({word})), "
            f"concat('given|', {gender}, '|', {_script(word)}, '|', lower({word})))")


def values_of(e: str, k: str) -> str:
    """SQL: the canonical values of entity ``e`` of kind ``k``, an array."""
    words = f"split({_untitled(e)}, ' ')"
    return (f"CASE {k} WHEN 'email' THEN array(concat('email|', lower({e}))) WHEN 'ip' THEN array(concat('ip|', {e})) "
            f"WHEN 'secret' THEN array(concat('secret|', {e})) WHEN 'card' THEN array(concat('card|', {_digits(e)})) "
            f"WHEN 'ssn' THEN array(concat('ssn|', {_digits(e)})) "
            f"WHEN 'phone' THEN array(concat('phone|', IF({e} LIKE '+%', '+', ''), {_digits(e)})) "
            f"ELSE flatten(transform({words}, (w, j) -> transform(split(w, '-'), u -> {_name_value('u', 'j', words, k)}))) END")


def surrogate(v: str, attempt: str, key: str) -> str:
    """SQL: the replacement (in canonical form) of value ``v`` at ``attempt`` under ``key``.

    Every drawn number is a 64-bit hash of the position and of a digest of key, attempt and value. The key enters the
    SQL text as a digest only, so it may hold any character and stands in no plan or log.
    """
    seed = f"sha2(concat('{hashlib.sha256(key.encode()).hexdigest()}', '|', {attempt}, '|', {v}), 256)"

    def draw(i: str, n: str) -> str:
        return f"pmod(xxhash64(h, {i}), {n})"
    letters = (f"CASE WHEN c RLIKE '[0-9]' THEN char(48 + {draw('i', '10')}) WHEN c RLIKE '[a-z]' THEN char(97 + {draw('i', '26')}) "
               f"WHEN c RLIKE '[A-Z]' THEN char(65 + {draw('i', '26')}) ELSE c END")
    # Mail: the local part and all labels but the last one change; the last (".com") stays.
    tail = "regexp_extract(p, r'([.][^.]*)$', 1)"
    mail = f"concat(array_join(transform(split(left(p, length(p) - length({tail})), ''), (c, i) -> {letters}), ''), {tail})"
    secret = (f"array_join(transform(split(p, ''), (c, i) -> CASE WHEN p RLIKE '^[0-9a-f]+$' THEN lower(hex({draw('i', '16')})) "
              f"WHEN i < IF(p LIKE 'sk-%', 3, 4) THEN c ELSE {letters} END), '')")
    ip = f"concat_ws('.', transform(array(1, 2, 3, 4), i -> string(1 + {draw('i', '254')})))"

    def drawn(kept: str) -> str:
        return f"array_join(transform(split(p, ''), (c, i) -> IF(i < {kept}, c, char(48 + {draw('i', '10')}))), '')"
    phone = drawn(f"length(regexp_extract(p, r'{_CODE}', 0))")
    body = f"left({drawn('1')}, length(p) - 1)"
    card = f"concat({body}, string(pmod(10 - {_luhn(body, 0)} % 10, 10)))"

    def word(script: str, count: str, at: int) -> str:
        n = len(SYLLABLES[script])
        return f"array_join(transform(sequence(1, {count}), j -> {_array(SYLLABLES[script])}[int({draw(f'{at} + j', str(n))})]), '')"
    scripts = ("latin", "cyrillic")
    family = f"IF({v} LIKE 'family|cyrillic|%', {word('cyrillic', f'3 + {attempt}', 20)}, {word('latin', f'3 + {attempt}', 20)})"
    given = "CASE " + " ".join(
        f"WHEN {v} LIKE 'given|{g}|{s}|%' THEN lower(concat({_array(GIVEN[g, s])}[int({draw('1', str(len(GIVEN[g, s])))})], "
        f"IF({attempt} > 0, {word(s, f'greatest(1, {attempt})', 40)}, '')))" for g in ("f", "m", "n") for s in scripts) + " END"
    by_kind = (f"CASE substring_index({v}, '|', 1) WHEN 'email' THEN {mail} WHEN 'secret' THEN {secret} WHEN 'ip' THEN {ip} WHEN 'card' THEN {card} "
               f"WHEN 'phone' THEN {phone} WHEN 'family' THEN {family} WHEN 'given' THEN {given} ELSE {drawn('0')} END")
    # The seed is bound once as h, the value without its kind as p.
    return f"transform(array(substring_index({v}, '|', -1)), p -> transform(array({seed}), h -> {by_kind})[0])[0]"


def rewritten(e: str, k: str, made) -> str:
    """SQL: the text of entity ``e`` of kind ``k`` after replacement; ``made`` gives the SQL of a value's replacement."""
    def one(prefix: str, payload: str) -> str:
        return made(f"concat('{prefix}|', {payload})")

    def placed(digits: str) -> str:  # the digits go where the old ones stood
        return (f"transform(array({digits}), m -> array_join(transform(split({e}, ''), (c, i) -> IF(c RLIKE '[0-9]', "
                f"substring(m, length({_digits(f'left({e}, i + 1)')}), 1), c)), ''))[0]")
    mail = (f"array_join(zip_with(split({e}, ''), split({one('email', f'lower({e})')}, ''), (c, x) -> IF(c RLIKE '[A-Z]', upper(x), x)), '')")
    phone = made(f"concat('phone|', IF({e} LIKE '+%', '+', ''), {_digits(e)})")
    words = f"split({_untitled(e)}, ' ')"
    part = made(_name_value("u", "j", words, k))
    name = (f"concat(regexp_extract({e}, r'^({_TITLE} )', 1), array_join(transform({words}, (w, j) -> "
            f"array_join(transform(split(w, '-'), u -> initcap({part})), '-')), ' '))")
    return (f"CASE {k} WHEN 'email' THEN {mail} WHEN 'ip' THEN {one('ip', e)} WHEN 'secret' THEN {one('secret', e)} "
            f"WHEN 'card' THEN {placed(one('card', _digits(e)))} WHEN 'ssn' THEN {placed(one('ssn', _digits(e)))} "
            f"WHEN 'phone' THEN {placed(_digits(phone))} ELSE {name} END")


def _split_at(text: Column, pattern: str | Column, mark: Column) -> Column:
    """The text cut before and after every match: gap, match, gap, ..."""
    bracketed = F.regexp_replace(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.concat(mark, F.lit("$0"), mark))
    return F.split(bracketed, mark, -1)


def with_pieces(docs: DataFrame, out: str) -> DataFrame:
    """``docs`` with ``out``: the pieces (t, k) of texts that hold entities, k null for gaps; null for all other texts."""
    text = F.col("text")
    # A text that holds the mark gets one with the text's own digest behind it.
    mark = F.when(F.contains(text, F.lit(MARK)), F.concat(F.lit(MARK), F.md5(text))).otherwise(F.lit(MARK))
    docs = docs.withColumn(f"{out}m", mark)
    mark = F.col(f"{out}m")
    # Without an "@" there is no mail address to look for.
    cut = F.when(F.contains(text, F.lit("@")), _split_at(text, ENTITY, mark)).otherwise(_split_at(text, WITHOUT_MAIL, mark))
    docs = docs.withColumn(out, cut)
    docs = docs.withColumn(out, F.when(F.size(out) > 1, F.expr(f"transform(`{out}`, (p, i) -> named_struct('t', p, 'k', IF(i % 2 = 1, {kind('p')}, NULL)))")))
    # Names of the text without their titles, each with the gender of its first mention.
    named = f"filter(`{out}`, x -> x.k IN ('f', 'm', 'n'))"
    both = f"flatten(transform({named}, x -> transform(array({_untitled('x.t')}, element_at(split({_untitled('x.t')}, ' '), -1)), n -> named_struct('n', n, 'g', x.k))))"
    docs = docs.withColumn(f"{out}n", F.when(F.size(F.expr(named)) > 0, F.expr(both)))
    names = F.expr(f"concat(r'(?<!\\p{{L}})(?:', array_join(array_sort(array_distinct(transform(`{out}n`, x -> x.n)), "
                   r"(a, b) -> length(b) - length(a)), '|'), r')(?!\p{L})')")
    docs = docs.withColumn(f"{out}p", names)
    again = (f"flatten(transform(`{out}`, x -> IF(x.k IS NULL, transform(split(regexp_replace(x.t, `{out}p`, concat(`{out}m`, '$0', `{out}m`)), `{out}m`, -1), "
             f"(p, i) -> named_struct('t', p, 'k', IF(i % 2 = 1, filter(`{out}n`, n -> n.n = p)[0].g, NULL))), array(x))))")
    docs = docs.withColumn(out, F.when(F.col(f"{out}n").isNotNull(), F.expr(again)).otherwise(F.col(out)))
    held = F.when(F.exists(out, lambda x: x["k"].isNotNull()), F.col(out))
    return docs.withColumn(out, held).drop(f"{out}m", f"{out}n", f"{out}p")


def later_attempts(values: DataFrame, key: str, rounds: int = 32) -> DataFrame | None:
    """(value, attempt) of the distinct ``values`` whose first replacement collides; None if there are none.

    Of the values that share a replacement the smallest keeps it. Raises if ``rounds`` do not suffice.
    """
    made = "concat(substring_index(value, '|', IF(value LIKE 'given|%', 3, IF(value LIKE 'family|%', 2, 1))), '|', {})".format(surrogate("value", "attempt", key))
    # Given names are told apart whatever their gender.
    place = "regexp_replace({}, '^given[|].[|]', 'given|')"
    state = staged(values.withColumn("attempt", F.lit(0)).withColumn("made", F.expr(place.format(made))), "surrogates")
    real = values.select(F.expr(place.format("value")).alias("made"), F.lit(True).alias("real")).distinct()
    for _ in range(rounds):
        least = state.groupBy("made").agg(F.count("*").alias("n"), F.min("value").alias("least")).where("n > 1").drop("n")
        bad = (state.join(least, "made", "left").join(real, "made", "left")
               .where("real OR value != least").select("value"))
        bad = staged(bad.distinct(), "collisions")
        if bad.isEmpty():
            moved = state.where("attempt > 0").select("value", "attempt")
            return None if moved.isEmpty() else moved
        again = state.join(bad, "value", "left_semi").withColumn("attempt", F.col("attempt") + 1)
        again = again.withColumn("made", F.expr(place.format(made)))
        state = staged(state.join(bad, "value", "left_anti").unionByName(again), "surrogates")
    raise ValueError("replacements still collide; use another key")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """All columns of ``docs`` with personal data in ``text`` replaced, and ``n_entities`` (long).

    Null text stays null with 0 entities; texts without entities come back unchanged, whatever their length; every row is
    rewritten by itself, so repeats stay equal. A column called n_entities is replaced, all others come back as they
    are. The rows are written once with the entities found, to the shared folder.
    """
    docs = docs.drop("n_entities")
    names = docs.columns
    out = "__pieces"
    while any(c.startswith(out) for c in names):
        out += "_"
    rows = staged(with_pieces(docs, out), "pieces")
    each = f"flatten(transform(filter(`{out}`, x -> x.k IS NOT NULL), x -> {values_of('x.t', 'x.k')}))"
    values = staged(rows.where(F.col(out).isNotNull()).select(F.explode(F.expr(each)).alias("value")).distinct(), "values")
    moved = later_attempts(values, key)
    later = f"{out}l"
    if moved is None:
        attempt = lambda v: "0"
        held = rows
    else:
        # Texts that hold a moved value get their own small map of attempts; those without entities take no part.
        some = rows.where(F.col(out).isNotNull()).withColumn(f"{out}h", text_key())
        holders = (some.select(f"{out}h", F.explode(F.array_distinct(F.expr(each))).alias("value")).join(moved, "value").groupBy(f"{out}h")
                   .agg(F.map_from_entries(F.collect_set(F.struct("value", "attempt"))).alias(later)))
        some = some.join(holders, f"{out}h", "left").drop(f"{out}h")
        held = some.unionByName(rows.where(F.col(out).isNull()).withColumn(later, F.lit(None).cast(some.schema[later].dataType)))
        attempt = lambda v: f"coalesce(`{later}`[{v}], 0)"
    # A value is bound once, as z, before its attempt is looked up.
    made = lambda v: f"transform(array({v}), z -> {surrogate('z', attempt('z'), key)})[0]"
    text = F.expr(f"array_join(transform(`{out}`, x -> CASE WHEN x.k IS NULL THEN x.t ELSE {rewritten('x.t', 'x.k', made)} END), '')")
    text = F.when(F.col(out).isNull(), F.col("text")).otherwise(text)
    n = F.when(F.col(out).isNull(), F.lit(0)).otherwise(F.size(F.filter(out, lambda x: x["k"].isNotNull())))
    return held.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in names], n.cast("long").alias("n_entities"))
