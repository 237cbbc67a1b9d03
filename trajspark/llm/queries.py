"""The thirteen operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, html_extract, lexical_search, minhash_dedup, quality_model, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, token_alignment, token_store, url_rules
from .common import scratch_path

#: (host, path, verdict)
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_rid")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score_documents(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_digests(table(spark, sf_dir, "documents"))


def suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(r, ("host", "path", "verdict"), strict=True)]) for r in URL_RULES]))
    return url_rules.filter_urls(table(spark, sf_dir, "pages"), spark.range(1).select(rows))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_store.read_store(spark, path, digest=True)


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"), digest=True)


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": leaks,
    "op2_quality_classifier": quality,
    "op3_bpe": bpe_digests,
    "op4_substring_dedup": substrings,
    "op5_simhash_dedup": simhash,
    "op6_suffix_array_dedup": suffixes,
    "op7_html_extraction": html,
    "op8_quality_rules": rules,
    "op9_url_filters": urls,
    "op10_token_store": tokens,
    "op11_token_alignment": alignment,
    "op12_lexical_search": ranked,
    "op13_minhash_dedup": minhash,
}

_WORD = r"[^\x20\x09-\x0D]+"
_LISTS = ", ".join(f"('{lang}', {k}, '{w}')" for lang, ws in quality_rules.COMMON_WORDS.items() for k, w in enumerate(ws))
_CLASS_COUNTS = ", ".join(f"length(text) - length(translate(text, {'||'.join(f'chr({ord(c)})' for c in chars)}, ''))" for chars in quality_rules.CLASSES.values())
_JS = """SELECT n, CASE WHEN sum(c) > 0 AND sum(r) > 0 THEN sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) END AS d
  FROM (SELECT f.n, f.c, r.r, f.c / sum(f.c) OVER (PARTITION BY f.n)::DOUBLE AS p, r.r / sum(r.r) OVER (PARTITION BY f.n)::DOUBLE AS q
        FROM {0} f JOIN (SELECT lang, k, sum(c) AS r FROM {0} WHERE NOT base_failed GROUP BY ALL) r USING (lang, k)) GROUP BY n"""
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
ORACLE_SQL: dict[str, str] = {
    "op9_url_filters": rf"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_ROWS}),
parts AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
matched AS (
  SELECT p.*, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rule_host) + length(rule_path) DESC NULLS LAST, length(rule_host) DESC) AS place
  FROM parts p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM matched WHERE place = 1
""",
    "op4_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM later, range(0, 20) t(o)),
counted AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN left_over USING (doc_id)
""",
    "op8_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, lower(coalesce(lang, '')) AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
tri AS (SELECT n, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT n, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT n, count(DISTINCT i + o) AS r FROM (SELECT n, i, count(*) OVER (PARTITION BY n, s) AS k FROM tri), range(0, 3) t(o) WHERE k > 1 GROUP BY n),
lines AS (SELECT n, [x for x in string_split(text, chr(10)) if regexp_matches(x, '{_WORD}')] AS l FROM d),
base AS (
  SELECT n, doc_id, lang, text, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words,
         len(w) < {quality_rules.BASE_WORDS} OR 100 * coalesce(r, 0) > 50 * len(w) AS base_failed
  FROM d JOIN lines USING (n) LEFT JOIN rep USING (n)),
class_lists AS (SELECT n, lang, base_failed, length(text) AS size, [{_CLASS_COUNTS}] AS c FROM base),
char_counts AS (SELECT n, lang, base_failed, unnest(list_append(c, size - list_sum(c)::BIGINT)) AS c, unnest(range(0, {len(quality_rules.CLASSES) + 1})) AS k FROM class_lists),
lists(lang, k, word) AS (VALUES {_LISTS}),
spoken AS (SELECT n, lang, rtrim(translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,;:!?') AS word FROM base),
listed AS (SELECT n, k, count(*) AS c FROM spoken JOIN lists USING (lang, word) GROUP BY ALL),
word_counts AS (
  SELECT n, lang, base_failed, lists.k, coalesce(c, 0) AS c FROM base JOIN lists USING (lang) LEFT JOIN listed USING (n, k)
  UNION ALL SELECT n, lang, base_failed, {quality_rules.N_WORDS}, n_words - coalesce((SELECT sum(c) FROM listed WHERE listed.n = base.n), 0) FROM base WHERE lang IN (SELECT lang FROM lists)),
char_d AS ({_JS.format('char_counts')}),
word_d AS ({_JS.format('word_counts')})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words >= {quality_rules.LEAST_WORDS} AND (coalesce(c.d > {quality_rules.CHAR_LIMIT[0]} + {quality_rules.CHAR_LIMIT[1]} / sqrt(length(text)), false) OR coalesce(v.d > {quality_rules.WORD_LIMIT[0]} + {quality_rules.WORD_LIMIT[1]} / sqrt(n_words), false))) AS kept,
       round(c.d, 6) AS char_distance, round(v.d, 6) AS word_distance
FROM base LEFT JOIN char_d c USING (n) LEFT JOIN word_d v USING (n)
""",
    "op12_lexical_search": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{lexical_search.TERM}') AS t FROM documents),
totals AS (SELECT count(*) AS c, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
lengths AS (SELECT doc_id, len(t) AS n, 100 - 90 + (90 * len(t) * c) // l AS m FROM d, totals WHERE len(t) > 0),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * c + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY term, c),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{lexical_search.TERM}')) AS term FROM benchmark),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM scores WHERE score > 0) WHERE rank <= 10
""",
    "op13_minhash_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM met JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id <= coalesce(y, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
""",
}
