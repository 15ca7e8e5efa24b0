"""The registered queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, arrowfile, balltree, hardneg, lexical, linededup, mil, mixing, packing, pii, quality_rules, simhash, urlfilter
from .common import read

WINDOW = 2048
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
TARGETS = mixing.Targets(domain={"domain0": 5, "domain1": 3, "domain2": 2}, lang={"en": 6, "de": 2, "fr": 2})
PII_KEY = "scoreline-surrogates-1"
LEAST_QUALITY = 0.7


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_url_filter(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, URL_RULES).drop("url")


def op2_packing(spark, sf_dir):
    packed = packing.pack(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), WINDOW)
    return packed.select("doc_id", "start", "length", packing.ids_crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op3_quality_rules(spark, sf_dir):
    return quality_rules.judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_nearest(spark, sf_dir):
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_line_dedup(spark, sf_dir):
    return linededup.duplicate_lines(read(spark, sf_dir, "documents"), min_exact=1).drop("th")


def op6_surrogates(spark, sf_dir):
    key = spark.conf.get("spark.scoreline.pii.key", PII_KEY)  # a deployment sets its own
    return pii.replace_entities(read(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op7_quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = mil.fit(docs, read(spark, sf_dir, "labels"))
    return mil.score(docs, model).select(
        "doc_id", mil.held_out().alias("held_out"), "score", (F.col("score") >= LEAST_QUALITY).cast("int").alias("predicted"))


def op8_arrow_files(spark, sf_dir):
    folder = arrowfile.new_folder(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = arrowfile.write(docs, tokenizer("byte_bpe_50k.json"), folder, WINDOW)
    return arrowfile.read(manifest, folder, WINDOW)


def op9_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"), TARGETS).drop("th")


def op10_simhash(spark, sf_dir):
    found = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_exact_topk(spark, sf_dir):
    return balltree.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op12_hard_negatives(spark, sf_dir):
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hardneg.mine(read(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_lexical_search(spark, sf_dir):
    return lexical.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=50)


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_packing, op3_quality_rules, op4_nearest, op5_line_dedup, op6_surrogates,
    op7_quality_classifier, op8_arrow_files, op9_mixing, op10_simhash,
    op11_exact_topk, op12_hard_negatives, op13_lexical_search)}

# DuckDB SQL of the queries that SQL can express. The others (learned scores, tokenizers, approximate search,
# edit joins, fingerprints) are tested against brute force in tests/llm.
_URL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), h AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p
), r(rule, rhost, rpath, verdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), best AS (
  SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL
)
SELECT h.page_id, h.host, h.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
FROM h LEFT JOIN best ON h.page_id = best.page_id
"""
_RULES = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), g AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {'p': i, 'g': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]})) AS x FROM w
), twice AS (
  SELECT doc_id, unnest(list(x.p)) AS p FROM g GROUP BY doc_id, x.g HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id
), f AS (
  SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 10 * n_symbols > word_chars AS f3,
         3 * n_dup_lines > n_words AS f4 FROM m
), host AS (
  SELECT source, count(*) AS n, unnest([1, 2, 3, 4]) AS rule,
         unnest([count(*) FILTER (f1), count(*) FILTER (f2), count(*) FILTER (f3), count(*) FILTER (f4)]) AS k FROM f GROUP BY source
), prior AS (
  SELECT rule, avg(k / n) AS mean, var_pop(k / n) AS v FROM host GROUP BY rule
), s AS (
  SELECT rule, mean, CASE WHEN v > 0 THEN greatest(1.0, least(1e6, mean * (1 - mean) / v - 1)) ELSE 1e6 END AS strength FROM prior
), bad AS (
  SELECT DISTINCT source FROM host JOIN s USING (rule) WHERE (k + mean * strength) / (n + strength) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
       NOT (f1 OR f2) AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM f.source) AS kept
FROM f
"""


def _fill(parent: str, name: str, weight: str, nodes: str, budget: str) -> str:
    """One level of budgets: nodes(parent, name, cap) and each parent's budget to (..., alloc)."""
    return f"""
  SELECT *, CASE WHEN is_full THEN usable ELSE (w * (b - sum(CASE WHEN is_full THEN usable ELSE 0 END) OVER p))
                 // sum(CASE WHEN is_full THEN 0 ELSE w END) OVER p END AS alloc
  FROM (SELECT *, w = 0 OR usable * sum(w) OVER (PARTITION BY {parent} ORDER BY cap / nullif(w, 0) NULLS LAST, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
               <= w * (b - coalesce(sum(usable) OVER (PARTITION BY {parent} ORDER BY cap / nullif(w, 0) NULLS LAST, {name}
                                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full
        FROM (SELECT *, CASE WHEN w > 0 THEN cap ELSE 0 END::HUGEINT AS usable
              FROM (SELECT n.*, ({weight})::HUGEINT AS w, ({budget})::HUGEINT AS b FROM {nodes})))
  WINDOW p AS (PARTITION BY {parent})"""


def _weight(level: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(getattr(TARGETS, level).items()))
    return f"CASE n.{level} {cases} ELSE {TARGETS.default} END" if cases else str(TARGETS.default)


_MIX = f"""
WITH t AS (
  SELECT DISTINCT doc_id, text, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
         CASE WHEN source IS NULL THEN 'none' WHEN regexp_matches(source, '[0-9]+$')
              THEN 'domain' || (regexp_extract(source, '[0-9]+$')::BIGINT % 3) ELSE 'other' END AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents
), leaf AS (
  SELECT domain, lang, source, sum(tokens) AS avail, sum(tokens) * 2 AS cap FROM t WHERE tokens > 0 GROUP BY ALL
), dom AS ({_fill("1", "domain", _weight("domain"), "(SELECT domain, sum(cap) AS cap FROM leaf GROUP BY ALL) n", "(SELECT sum(avail) * 60 // 100 FROM leaf)")}
), lng AS ({_fill("domain", "lang", _weight("lang"), "(SELECT domain, lang, sum(cap) AS cap FROM leaf GROUP BY ALL) n JOIN dom ON dom.domain = n.domain", "dom.alloc")}
), src AS ({_fill("domain, lang", "source", _weight("source"), "leaf n JOIN lng ON lng.domain = n.domain AND lng.lang = n.lang", "lng.alloc")}
), k AS (
  SELECT t.*, alloc // avail AS whole, alloc % avail AS rest, md5(concat_ws('/', '42', (alloc // avail + 1)::VARCHAR, t.doc_id::VARCHAR)) AS key
  FROM t JOIN src ON t.domain = src.domain AND t.lang = src.lang AND t.source = src.source WHERE tokens > 0
), c AS (
  SELECT *, greatest(0, least(tokens, rest - coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS part FROM k
)
SELECT doc_id, domain, lang, source, tokens, (whole + (part > 0)::INT)::BIGINT AS epochs,
       (whole * tokens + part)::BIGINT AS take_tokens
FROM c WHERE whole + (part > 0)::INT > 0
"""
_FINITE = "{0} IS NOT NULL AND len(list_filter({0}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
_TOPK = f"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND {_FINITE.format("embedding")}
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 10
"""
_HARD = f"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINITE.format("embedding")}
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_LEXICAL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents
), one AS (
  SELECT count(*) AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0
), tf AS (
  SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
  FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY row, term
), df AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, one GROUP BY term
), item AS (
  SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark
), s AS (
  SELECT item_id, row, any_value(doc_id) AS doc_id,
         sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * tf.n * docs) // words))))::BIGINT AS score
  FROM item JOIN df USING (term) JOIN tf USING (term), one GROUP BY item_id, row
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY rank <= 50
"""
ORACLE_SQL = {"op11_exact_topk": _TOPK, "op12_hard_negatives": _HARD, "op13_lexical_search": _LEXICAL, "op1_url_filter": _URL, "op3_quality_rules": _RULES, "op9_mixing": _MIX}
