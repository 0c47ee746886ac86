"""The operators of this subpackage as queries over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmltext, jaccard, knlm, langid, licenses, quality, spans, spm, warc
from .shards import Scratch


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, remainder: int):
    return F.coalesce(knlm.remainder("doc_id", modulus) == remainder, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out(4, 2)), Scratch(spark))
    out = langid.predict(docs, model)
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = quality.cascade(docs, quality.measure_rules(docs))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = knlm.train(docs.where(~held_out(10, 0)), Scratch(spark))
    out = knlm.score(docs, model)
    return out.select("doc_id", held_out(10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(read(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = spans.remove(docs, spans.repeats(docs, Scratch(spark)))
    return out.select("doc_id", "text", F.col("_sentences").alias("n_sentences"), F.col("_removed").alias("n_removed"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.records(warc.write(read(spark, sf_dir, "pages"), Scratch(spark)))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_quality_rules, op3_lm_scoring, op4_sentencepiece, op5_html_text, op6_license_scan, op7_ngram_jaccard, op8_substring_dedup, op9_warc, op10_decontamination)
    return {f.__name__: f for f in found}


_SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_SQL_WORDS} AS w FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM win),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
full_lines AS (SELECT r, line FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n, count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*[-*•]')) AS bullets, count(*) FILTER (regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS ellipses FROM full_lines GROUP BY r),
pairs AS (SELECT r, max(n) AS n FROM (SELECT r, ab, count(*) AS n FROM (SELECT r, unnest(list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])) AS ab FROM d) GROUP BY r, ab) GROUP BY r),
top AS (SELECT r, max(n) AS n FROM (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY r, word) GROUP BY r),
b AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(dup.n_lines, 0) AS n_lines, coalesce(dup.bullets, 0) AS bullets, coalesce(dup.ellipses, 0) AS ellipses, coalesce(top.n, 0) AS top, coalesce(pairs.n, 0) AS top_pair, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS alpha
  FROM d LEFT JOIN rep ON d.r = rep.r LEFT JOIN dup ON d.r = dup.r LEFT JOIN top ON d.r = top.r LEFT JOIN pairs ON d.r = pairs.r),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words) AND NOT 10 * n_symbols > n_words
  AND NOT 10 * n_dup_lines > 3 * n_lines AND NOT 10 * alpha < 8 * n_words AND NOT 10 * top > 3 * n_words
  AND NOT 10 * top_pair > 2 * n_words AND NOT 10 * bullets > 9 * n_lines AND NOT 10 * ellipses > 3 * n_lines AS kept
FROM f
"""

_OP5 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS x FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') AS x FROM b),
t AS (SELECT page_id, url, trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL_LETTERS = rf"regexp_extract_all(translate(%s, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _op6() -> str:
    length = {t: licenses.run_length(len(words)) for t, _, words in licenses._templates()}
    templates = ", ".join(f"({t}, '{label}', [{', '.join(repr(w) for w in words)}], {licenses.needed(words)}, {length[t]})" for t, label, words in licenses._template_words())
    phrases = " UNION ALL ".join(
        f"SELECT r, i - 1 AS i, '{label}' AS label FROM spot WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) for phrase, label in licenses.PHRASES.items()
    )
    return rf"""
WITH t(template, label, words, need, run) AS (VALUES {templates}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_SQL_LETTERS % "coalesce(text, '')"} AS w FROM documents),
spot AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_contains(w, 'license')),
p AS ({phrases}),
base AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, list_sort(list(DISTINCT label)) AS labels FROM p GROUP BY r),
c AS (SELECT r, label, w, t.words AS tw, need, run FROM d, t WHERE len(list_intersect(list_distinct(w), t.words)) >= need),
block AS (SELECT r, label, tw, need, unnest(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains(tw, w[i])), lambda i: len(list_intersect(list_distinct(w[i : i + run - 1]), tw)))) AS n FROM c),
hit AS (SELECT r, label, n / len(tw) AS share FROM block WHERE n >= need),
m AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM hit GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(base.lo AS BIGINT) AS first_word, CAST(base.hi AS BIGINT) AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
  CAST(coalesce(m.share, 0) AS DOUBLE) AS score
FROM d LEFT JOIN base ON d.r = base.r LEFT JOIN m ON d.r = m.r
"""


_OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, h FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS h FROM d)),
n AS (SELECT d.doc_id, count(s.h) AS n FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.other)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, least_id AS component_id FROM n JOIN (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY doc_id) r ON n.doc_id = r.doc_id
"""

_PIECE = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
_SPAN_ENDS = " OR ".join(f"(z.u - a.u + 1 >= {m} AND z.upto - a.before >= {w})" for m, w in spans.RUNS)

_OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_PIECE}') AS p FROM documents),
t0 AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS piece FROM d),
t AS (SELECT doc_id, i, piece, translate(regexp_extract(piece, '[^\x20\x09-\x0D]+'), '{_UPPER}', '{_LOWER}') AS word FROM t0),
e AS (SELECT *, CASE WHEN regexp_matches(word, '[.!?]$') OR contains(piece, chr(10)) THEN 1 ELSE 0 END AS ends FROM t),
s AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM e),
c AS (SELECT *, CASE WHEN ends = 1 OR (count(*) OVER (PARTITION BY doc_id, sentence) > {spans.RUN_ON} AND regexp_matches(word, '[,;:|]$')) THEN 1 ELSE 0 END AS cut FROM s),
u0 AS (SELECT *, CAST(coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS u FROM c),
unit AS (SELECT doc_id, u, count(*) AS n, max(i) AS upto, min(i) - 1 AS before, string_agg(piece, '' ORDER BY i) AS raw, string_agg(word, ' ' ORDER BY i) AS words FROM u0 GROUP BY doc_id, u),
pair AS (SELECT a.doc_id, a.u AS a, z.u AS z FROM unit a JOIN unit z ON a.doc_id = z.doc_id AND z.u BETWEEN a.u AND a.u + 49 WHERE {_SPAN_ENDS}),
span AS (SELECT doc_id, a, min(z) AS z FROM pair GROUP BY doc_id, a UNION SELECT doc_id, max(a), z FROM pair GROUP BY doc_id, z),
full_span AS (SELECT s.doc_id, s.a, s.z, string_agg(unit.words, ' ' ORDER BY unit.u) AS words FROM span s JOIN unit ON unit.doc_id = s.doc_id AND unit.u BETWEEN s.a AND s.z GROUP BY s.doc_id, s.a, s.z),
ranked AS (SELECT doc_id, a, z, rank() OVER (PARTITION BY words ORDER BY doc_id, a) AS r FROM full_span),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS u FROM ranked WHERE r > 1),
kept AS (SELECT unit.doc_id, count(*) AS n, count(gone.u) AS lost, coalesce(string_agg(CASE WHEN gone.u IS NULL THEN raw ELSE '' END, '' ORDER BY unit.u), '') AS text
  FROM unit LEFT JOIN gone ON unit.doc_id = gone.doc_id AND unit.u = gone.u GROUP BY unit.doc_id)
SELECT d.doc_id, CASE WHEN coalesce(lost, 0) = 0 THEN o.text WHEN lost = kept.n THEN '' ELSE regexp_extract(d.text, '^[\x20\x09-\x0D]*') || kept.text END AS text,
  CAST(coalesce(kept.n, 0) AS BIGINT) AS n_sentences, CAST(coalesce(lost, 0) AS BIGINT) AS n_removed
FROM d JOIN documents o ON o.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

_OP9 = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda j: substr('0000000100100011010001010110011110001001101010111100110111101111', CAST(4 * (instr('0123456789abcdef', substr(h, CAST(j AS INTEGER), 1)) - 1) + 1 AS INTEGER), 4)), '') AS bits,
  min(page_id) OVER (PARTITION BY h, n) AS f FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(0, 5), lambda k: CAST(substr(bits, CAST(5 * i + k + 1 AS INTEGER), 1) AS INTEGER) * CAST(pow(2, 4 - k) AS INTEGER))) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _OP2, "op5_html_text": _OP5, "op6_license_scan": _op6(), "op7_ngram_jaccard": _OP7, "op8_substring_dedup": _OP8, "op9_warc": _OP9}
