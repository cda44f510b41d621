"""The registered corpus queries and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jamscope.llm import (
    bpe,
    byte_bpe,
    divergence,
    fingerprints,
    language,
    lines,
    mixing,
    quality,
    resampling,
    simhash,
    token_counts,
    toxicity,
    urls,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints.fingerprint_report(docs)


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_report(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_report(table(spark, sf_dir, "pages").select("page_id", "url"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity_report(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.bpe_report(docs, bpe.Bpe.read(public_tokenizers.path("word_bpe_49k.json")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.language_report(docs)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.Mixture(docs).report()


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampling.resampling_report(docs, table(spark, sf_dir, "benchmark").select("text"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_report(
        table(spark, sf_dir, "documents").select("text", "lang", "source")
    )


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.byte_bpe_report(docs, byte_bpe.ByteBpe.read(path, public_tokenizers.PATTERN))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_rules,
        op2_fingerprints,
        op3_lines,
        op4_token_counts,
        op5_urls,
        op6_toxicity,
        op7_bpe,
        op8_language,
        op9_simhash,
        op10_mixing,
        op11_resampling,
        op12_divergence,
        op13_byte_bpe,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": OP1_SQL,
        "op3_lines": OP3_SQL,
        "op11_resampling": OP11_SQL,
        "op12_divergence": OP12_SQL,
    }


OP1_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM (
    SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
    FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM docs))),
repeats AS (
  SELECT r, count(*) AS n_repeat_words FROM (
    SELECT DISTINCT r, i + k AS p FROM windows, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1)
  GROUP BY r),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (
  SELECT doc_id, t, len(w)::BIGINT AS n_words,
    length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines,
    length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS capitals
  FROM docs LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 35 * n_lines
    OR 100 * capitals > 30 * word_chars
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM judged
"""

OP3_SQL = r"""
WITH raw AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts
  FROM documents),
lines AS (
  SELECT r, doc_id, line, list_sort(list_distinct(words)) AS words FROM (
    SELECT r, doc_id, i - 1 AS line,
      regexp_extract_all(parts[i], '[^\x20\x09-\x0D]+') AS words
    FROM (SELECT r, doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM raw))
  WHERE len(words) > 0),
sets AS (
  SELECT row_number() OVER () AS s, words, len(words) AS n, first FROM (
    SELECT words, min((doc_id, line)) AS first FROM lines GROUP BY words)),
tokens AS (SELECT s, n, first, unnest(words) AS word FROM sets),
pairs AS (
  SELECT a.s, b.s AS other, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM tokens a JOIN tokens b
    ON a.word = b.word AND b.first < a.first AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY a.s, b.s),
late AS (SELECT DISTINCT s FROM pairs WHERE 5 * c >= 4 * (n + m - c)),
gone AS (
  SELECT r, list_sort(list_distinct(list(line::INTEGER))) AS removed
  FROM lines JOIN sets USING (words)
  WHERE (doc_id, line) > first OR s IN (SELECT s FROM late) GROUP BY r)
SELECT doc_id, len(parts)::INTEGER AS n_lines,
  len(coalesce(removed, []::INTEGER[]))::INTEGER AS n_removed,
  coalesce(array_to_string(removed, ','), '') AS removed
FROM raw LEFT JOIN gone USING (r)
"""

#: A-Z lowered, as the operators do it.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
own AS (SELECT r, unnest(w) AS word FROM docs),
aim AS (
  SELECT unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark),
crc AS (
  SELECT list(c ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS t(i))),
words AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)),
      lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM own UNION SELECT word FROM aim)),
    crc),
s AS (SELECT bucket, count(*) AS s FROM own JOIN words USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aim JOIN words USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM own) AS own_n, (SELECT count(*) FROM aim) AS aim_n),
gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (own_n + 10000))::DOUBLE
    / ((s + 1) * (aim_n + 10000))::DOUBLE))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), sums),
weights AS (
  SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM own JOIN words USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((
      ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (r)),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS place,
    count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""

OP12_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
terms AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY ALL HAVING count(DISTINCT r) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS whole FROM kept GROUP BY lang),
found AS (
  SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term)
  GROUP BY ALL),
groups AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN found USING (lang, source) GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(f.n, 0) + 1) // (total + v)::HUGEINT AS p,
    1 + 1000000000::HUGEINT * (k.n + 1) // (whole + v)::HUGEINT AS q
  FROM groups g JOIN sizes USING (lang) JOIN kept k USING (lang)
    LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
tops AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
  FROM grid WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""
