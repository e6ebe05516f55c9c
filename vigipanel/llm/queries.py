"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from vigipanel.llm import (
    collocations, decontamination, jaccard_join, license_index, line_dedup, minhash_pairs, mixing, passages, quality_rules, repeats, toxicity, url_rules, whitening,
)
from vigipanel.llm.registry import COMPARISON, QUERIES, query

__all__ = ["QUERIES", "COMPARISON"]

URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

QUALITY_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g FROM t, unnest(range(1, len(w) - 3)) AS u(i)
), twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS s(k) GROUP BY r),
base AS (
  SELECT t.doc_id, t.text, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(t.text) - len(regexp_extract_all(t.text, '[\x20\x09-\x0D]')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN covered ON t.r = covered.r
), flagged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR 10 * n_symbols > n_words
    OR 10 * len(regexp_extract_all(text, '!')) > n_words
    OR 10 * len(regexp_extract_all(text, '[A-Z]')) > 3 * len(regexp_extract_all(text, '[A-Za-z]'))
    OR 10 * n_dup_lines > 3 * (1 + len(regexp_extract_all(text, '\n')))
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 2 * len(regexp_extract_all(text, '[A-Za-z\x{80}-\x{10FFFF}]')) < word_chars
    OR 10 * len(regexp_extract_all(text, '\.\.\.')) > n_words) AS kept
FROM flagged
"""

URL_SQL = r"""
WITH rule(action, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut AS (
  SELECT row_number() OVER () AS r, page_id,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), page AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), hit AS (
  SELECT r, rule.host || rule.path AS rule, action FROM page JOIN rule
  ON (page.host = rule.host OR ends_with(page.host, '.' || rule.host)) AND starts_with(page.path, rule.path)
), best AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM hit GROUP BY r)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM page LEFT JOIN best USING (r)
"""


def _license_sql() -> str:
    """Every template against every document by position, without an index."""
    known = license_index.templates()
    words = ", ".join(f"({k}, {i}, '{w}', {t['key_at'] <= i < t['key_at'] + len(t['key'])})" for k, t in enumerate(known) for i, w in enumerate(t["words"]))
    heads = ", ".join(f"({k}, '{t['label']}', {t['base']}, {len(t['words'])}, {len(t['key'])}, {t['key_at']})" for k, t in enumerate(known))
    return rf"""
WITH tw(t, i, w, in_key) AS (VALUES {words}), th(t, label, base, n, n_key, key_at) AS (VALUES {heads}),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a
  FROM documents
), dw AS (SELECT r, unnest(a) AS w, generate_subscripts(a, 1) - 1 AS p FROM d),
placed AS (SELECT r, t, p - i AS s, count(*) AS c, count(*) FILTER (in_key) AS k FROM dw JOIN tw USING (w) GROUP BY ALL),
found AS (SELECT r, label, base, s + key_at AS start, c / n AS share FROM placed JOIN th USING (t) WHERE k = n_key AND (base OR c / n >= {license_index.LEAST_SHARE})),
x AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM found GROUP BY r
)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM d LEFT JOIN x USING (r)
"""


COLLOCATION_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
gram AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) FROM w
), f AS (SELECT lang, size, phrase, count(*) AS f FROM gram GROUP BY ALL),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
candidate AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS p FROM f WHERE size >= 2 AND f >= 10),
cut AS (SELECT *, unnest(range(1, size)) AS k FROM candidate),
part AS (SELECT *, list_aggregate(p[1:k], 'string_agg', ' ') AS first, list_aggregate(p[k+1:size], 'string_agg', ' ') AS second FROM cut),
score AS (
  SELECT part.lang, part.phrase, part.size, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM part JOIN f x ON x.lang = part.lang AND x.phrase = first JOIN f y ON y.lang = part.lang AND y.phrase = second
), worst AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([p[1] || ' ' || p[2], p[2] || ' ' || p[3]]) AS phrase FROM candidate WHERE size = 3) GROUP BY ALL
), kept AS (
  SELECT worst.* FROM worst LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""


@query("op3_quality_rules", QUALITY_SQL)
def _(table):
    return quality_rules.judged(table("documents")).drop("text")


@query("op5_url_filters", URL_SQL)
def _(table):
    pages = table("pages")
    rules = pages.sparkSession.createDataFrame(URL_RULES, "action string, host string, path string")
    return url_rules.judged(pages, rules)


@query("op10_license_scans", _license_sql())
def _(table):
    return license_index.scanned(table("documents"))


@query("op2_benchmark_decontamination")
def _(table):
    return decontamination.contaminated(table("documents"), table("benchmark"))


@query("op6_mixing_sources")
def _(table):
    return mixing.mixed(table("documents"))


@query("op8_toxicity")
def _(table):
    docs = table("documents")
    return toxicity.scored(docs, toxicity.fitted(docs, table("labels")))


@query("op7_ngram_jaccard_join")
def _(table):
    return jaccard_join.joined(table("documents"))


@query("op1_line_dedup")
def _(table):
    return line_dedup.counted(table("documents"))


@query("op9_suffix_array_dedup")
def _(table):
    return repeats.removed(table("documents"))


@query("op4_compact_windows")
def _(table):
    return passages.passages(table("documents"))


@query("op11_phrase_collocations", COLLOCATION_SQL)
def _(table):
    return collocations.collocations(table("documents"))


@query("op12_minhash_near_dedup")
def _(table):
    return minhash_pairs.near_copies(table("documents"))


@query("op13_embedding_whitening")
def _(table):
    return whitening.whitened(table("embeddings"))
