"""The registered queries of this folder and, where SQL can say the same, the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat_rotation, decontaminate, html_layout, license_scan, near_dedup, parity_join, passages, pu_quality, quality_rules, spelling, toxicity, word_bpe
from .sampling import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _query(check: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if check is not None:
            CHECKS[build.__name__] = check
        return build

    return register


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM d),
spread AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
grams AS (
  SELECT doc_id, pos, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4, lead(word, 4) OVER o AS w5
  FROM spread WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
counted AS (
  SELECT doc_id, pos, CASE WHEN w5 IS NULL THEN 0 WHEN count(*) OVER (PARTITION BY doc_id, word, w2, w3, w4, w5) > 1 THEN 1 ELSE 0 END AS again FROM grams),
covered AS (
  SELECT doc_id, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM counted),
repeats AS (SELECT doc_id, sum(c) AS n_repeat_words FROM covered GROUP BY doc_id),
line_rows AS (SELECT doc_id, unnest(lines) AS line FROM w),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM line_rows WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^!]+', '', 'g')) AS n_exclamations,
    len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words,
    length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals
  FROM w LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR (n_symbols > 0 AND 4 * n_symbols >= n_words) OR (n_exclamations > 0 AND 4 * n_exclamations >= n_words)
    OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines) OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 2 * n_letter_words < n_words OR (n_letters >= 50 AND 10 * n_capitals > 6 * n_letters)) AS kept
FROM f
"""


@_query(_RULES_SQL)
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(_read(spark, sf_dir, "documents"))
    return rows.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("v1").alias("kept"),
    )


def _scored(rows: DataFrame, folds: int, out: int, threshold: float) -> DataFrame:
    rows = rows.select("row.doc_id", "score")
    held_out = F.coalesce(fold("doc_id", folds) == out, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@_query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(fold("doc_id", 4) != 2))
    return _scored(toxicity.score(docs, model), 4, 2, 0.3)


@_query()
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = pu_quality.fit(docs, labels.filter(fold("doc_id", 3) != 1))
    return _scored(pu_quality.score(docs, model), 3, 1, 0.5)


@_query()
def op8_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _classes_sql(percent: int, more: str = "") -> str:
    """Components of documents whose sets of four-word windows overlap."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [words]
    ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 2), lambda i: words[i:i + 3]))) END AS elements FROM d),
classes AS (SELECT min(doc_id) AS rep, elements, len(elements) AS n FROM sets WHERE len(elements) > 0 GROUP BY elements),
held AS (SELECT rep, n, unnest(elements) AS e FROM classes),
met AS (
  SELECT a.rep AS x, b.rep AS y FROM held a JOIN held b ON a.e = b.e AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM met UNION ALL SELECT y, x FROM met),
reach AS (SELECT rep AS id, rep AS root FROM classes UNION SELECT l.y, r.root FROM reach r JOIN links l ON r.id = l.x AND r.root < l.y),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT s.doc_id, CAST(len(s.elements) AS BIGINT) AS n_shingles, CASE WHEN len(s.elements) = 0 THEN s.doc_id ELSE root END AS component_id{more}
FROM sets s LEFT JOIN classes c ON s.elements = c.elements LEFT JOIN roots ON c.rep = roots.id
"""


_KEPT = ", coalesce(s.doc_id = CASE WHEN len(s.elements) = 0 THEN s.doc_id ELSE root END, false) AS kept"


@_query(_classes_sql(80, _KEPT))
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), width=4)


@_query()
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@_query()
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_read(spark, sf_dir, "documents"))


@_query()
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


@_query()
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract(_read(spark, sf_dir, "pages"))


_CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
sides AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
seen AS (
  SELECT t.*, perspective, speaker = perspective AS trained,
    CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
    CASE WHEN speaker <> perspective AND speaker <> 'system' THEN replace(speaker, '<|', '< |') END AS name
  FROM t JOIN sides ON t.conv_id IS NOT DISTINCT FROM sides.conv_id),
drawn AS (
  SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head,
    '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS rendered FROM seen),
placed AS (
  SELECT *, row_number() OVER o - 1 AS position, CAST(sum(length(rendered)) OVER o AS BIGINT) AS end_char
  FROM drawn WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, perspective, position, role, name, rendered, end_char - length(rendered) AS first_char, end_char, trained,
  CASE WHEN trained THEN end_char - length(rendered) + length(head) END AS train_from, CASE WHEN trained THEN end_char - 1 END AS train_till
FROM placed
"""


@_query(_CHAT_SQL)
def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate(_read(spark, sf_dir, "conversations"))


_SPELLING_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS step, i AS c FROM range(256) AS t(i)
  UNION ALL SELECT i, step + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
kept AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (
  SELECT doc_id, run, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM kept),
hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda p: CAST(('0x' || substr(x, CAST(p AS INTEGER), 2)) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc.t[1 + CAST(xor(c, b) % 256 AS INTEGER)])), 4294967295) AS h
  FROM bytes, crc),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) + 2 AS INTEGER)) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
-- a word without one character, and with a mark in the character's place
less AS (SELECT word, p, left(word, CAST(p - 1 AS INTEGER)) || substr(word, CAST(p + 1 AS INTEGER)) AS rest FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS p)),
near AS (
  SELECT a.word, b.word AS near FROM less a JOIN less b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word FROM less l JOIN words w ON l.rest = w.word),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(near.near, (-b.n, near.near)) AS best, max(b.n) AS best_n FROM near JOIN words b ON near.near = b.word GROUP BY near.word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
hops AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT h.word, f.form FROM hops h JOIN formed f ON h.at = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT h.word, h.at AS root FROM hops h JOIN formed f ON h.at = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""


@_query(_SPELLING_SQL)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_read(spark, sf_dir, "documents"))


@_query(_classes_sql(85))
def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_classes(_read(spark, sf_dir, "documents"), width=4, percent=85)


@_query()
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(_read(spark, sf_dir, "documents"), *paths)
