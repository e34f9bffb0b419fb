"""Queries over texts: words, units, contractions, phrases, letters, labels."""

from __future__ import annotations

from string import ascii_lowercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators import text
from loomspan.plans.registry import Catalog
from loomspan.session import table

catalog = Catalog()
query = catalog.query

_W = r"[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*"
#: DuckDB: words of the documents with offsets, as text.words gives them.
_WORDS = rf"""
WITH masked AS (SELECT doc_id, list_aggregate(list_transform(list_zip(string_split_regex(text, '\{{[^{{}}]*\}}'), regexp_extract_all(text, '\{{[^{{}}]*\}}')), lambda z: z[1] || repeat(' ', coalesce(length(z[2]), 0))), 'string_agg', '') AS t FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, regexp_extract_all(t, '{_W}') AS ws, string_split_regex(t, '{_W}') AS gs FROM masked),
each AS (SELECT doc_id, unnest(range(len(ws))) AS i, ws, gs FROM cut),
w AS (SELECT doc_id, CAST(i AS INTEGER) AS idx, ws[i + 1] AS word, gs[i + 1] AS pre, gs[i + 2] AS gap FROM each),
words AS (SELECT doc_id, idx, word, gap, CAST(sum(length(pre) + length(word)) OVER (PARTITION BY doc_id ORDER BY idx) AS INTEGER) AS char_end FROM w),
f AS (SELECT *, lead(word) OVER (PARTITION BY doc_id ORDER BY idx) AS nxt FROM words),
b AS (SELECT *, nxt IS NULL OR (contains(gap, '.') AND lower(word) NOT IN ('mr','mrs','ms','dr','prof','st','jr','sr','vs','etc') AND NOT (length(word) = 1 AND upper(word) = word AND lower(word) <> word AND nxt IS NOT NULL)
  AND NOT (regexp_matches(word, '^\p{{N}}+$') AND coalesce(regexp_matches(nxt, '^\p{{N}}+$'), false) AND gap = '.')) OR contains(gap, '?') OR contains(gap, '!') AS boundary FROM f),
u AS (SELECT *, CAST(coalesce(sum(CASE WHEN boundary THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS unit FROM b)
"""


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.words(table(spark, sf_dir, "documents"), "doc_id")


@query(_WORDS + "SELECT doc_id, idx, word, CAST(char_end - length(word) AS INTEGER) AS char_start, char_end FROM words")
def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with offsets, markers masked."""
    return document_words(spark, sf_dir).select("doc_id", "idx", "word", "char_start", "char_end")


@query(_WORDS + "SELECT doc_id, unit, min(idx) AS start_token, max(idx) + 1 AS end_token, CAST(min(char_end - length(word)) AS INTEGER) AS char_start, max(char_end) AS char_end FROM u GROUP BY ALL")
def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Punctuation-delimited units."""
    return text.units(text.unit_boundaries(document_words(spark, sf_dir), "doc_id"), "doc_id")


@query(
    _WORDS
    + """, p AS (SELECT doc_id, unit, count(*) AS n FROM u GROUP BY ALL)
SELECT d.source, CAST(count(*) AS BIGINT) AS n_units, round(avg(n), 4) AS mean_words FROM p JOIN documents d USING (doc_id) WHERE d.source IS NOT NULL GROUP BY d.source"""
)
def unit_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and their mean length per source."""
    counted = text.unit_boundaries(document_words(spark, sf_dir), "doc_id").groupBy("doc_id", "unit").agg(F.count("*").alias("n"))
    sources = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", "source")
    return counted.join(sources, "doc_id").groupBy("source").agg(F.count("*").alias("n_units"), F.round(F.avg("n"), 4).alias("mean_words"))


_PAIRS = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in pair) + ")" for pair in text.EXPANSIONS.items())


@query(_WORDS + f", e(k, v) AS (VALUES {_PAIRS}) SELECT v AS expansion, count(*) AS n FROM words JOIN e ON replace(lower(word), '’', '''') = k GROUP BY v")
def contractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contractions written out, counted by what they stand for."""
    parts = text.expanded(document_words(spark, sf_dir), "doc_id").groupBy("doc_id", "idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "token"))), lambda s: s.token), " ").alias("expansion"))
    return parts.where(F.contains("expansion", F.lit(" "))).groupBy("expansion").agg(F.count("*").alias("n"))


@query(
    _WORDS
    + """, c AS (SELECT doc_id, lower(word) AS w, idx, row_number() OVER (PARTITION BY doc_id, lower(word) ORDER BY idx) AS k FROM words)
SELECT doc_id, w AS word, CAST(max(k) AS INTEGER) AS occurrences, CAST(min(idx) AS INTEGER) AS first_idx, CAST(max(CASE WHEN k = 2 THEN idx END) AS INTEGER) AS second_idx FROM c GROUP BY ALL"""
)
def occurrence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running number of a word's occurrence in its text."""
    numbered = document_words(spark, sf_dir).select("doc_id", F.lower("word").alias("word"), "idx").withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "word").orderBy("idx")))
    return numbered.groupBy("doc_id", "word").agg(F.max("k").alias("occurrences"), F.min("idx").alias("first_idx"), F.max(F.when(F.col("k") == 2, F.col("idx"))).alias("second_idx"))


#: Phrases that are looked for, by number.
PHRASES = {1: "the phone rang", 2: "said no", 3: "they gave me a", 4: "in the dark", 5: "and then"}


@query(
    _WORDS
    + ", p(phrase_id, phrase, n) AS (VALUES "
    + ", ".join(f"({k}, '{v}', {len(v.split())})" for k, v in PHRASES.items())
    + """), r AS (SELECT doc_id, idx, lower(word) AS w0, lead(lower(word), 1) OVER o AS w1, lead(lower(word), 2) OVER o AS w2, lead(lower(word), 3) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY idx))
SELECT phrase_id, doc_id, idx AS start_token FROM r JOIN p ON phrase = list_aggregate([w0, w1, w2, w3][:n], 'string_agg', ' ') AND len(list_filter([w0, w1, w2, w3][:n], lambda x: x IS NOT NULL)) = n"""
)
def phrase_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a phrase of several words."""
    asked = spark.createDataFrame([(k, v.split()) for k, v in PHRASES.items()], "phrase_id int, tokens array<string>")
    return text.text_phrases(table(spark, sf_dir, "documents"), "doc_id", asked, "phrase_id")


@query(r"SELECT doc_id, regexp_replace(text, '\{[^{}]*\}', '', 'g') AS plain, CAST(len(regexp_extract_all(text, '\{[^{}]*\}')) AS INTEGER) AS n_markers FROM documents WHERE contains(text, '{')")
def marker_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without markers."""
    held = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("{")))
    return held.select("doc_id", F.regexp_replace("text", text.MARKER, "").alias("plain"), F.size(F.regexp_extract_all("text", F.lit(text.MARKER), F.lit(0))).alias("n_markers"))


@query(_WORDS + ", t AS (SELECT DISTINCT doc_id, lower(word) AS w FROM words) SELECT DISTINCT doc_id, name AS label FROM t JOIN known_name ON role = 'given' AND w IN (lower(name), lower(name) || 's', lower(name) || 'es')")
def lexical_attestation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that a text attests, also with a plural ending."""
    labels = table(spark, sf_dir, "known_name").where("role = 'given'").select(F.col("name").alias("label"))
    return text.attested(document_words(spark, sf_dir), "doc_id", labels)


@query(
    "SELECT source, letter, CAST(sum(length(lower(text)) - length(replace(lower(text), letter, ''))) AS BIGINT) AS n "
    "FROM documents, (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) AS letter) WHERE text IS NOT NULL GROUP BY ALL"
)
def letter_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 26 letters per source, null source too, over every text, by what removing them from the lower-case text shortens."""
    lower = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("source", F.lower("text").alias("t"))
    counts = lower.groupBy("source").agg(*[F.sum(F.length("t") - F.length(F.replace("t", F.lit(c), F.lit("")))).alias(c) for c in ascii_lowercase])
    return counts.select("source", F.explode(F.array(*[F.struct(F.lit(c).alias("letter"), F.col(c).alias("n")) for c in ascii_lowercase])).alias("l")).select("source", "l.letter", "l.n")


@query(_WORDS + "SELECT doc_id, CAST(count(*) AS BIGINT) AS n_words, round(avg(length(word)), 4) AS mean_length, round(stddev_pop(length(word)), 4) AS sd_length FROM words GROUP BY doc_id")
def word_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, mean and population deviation of word lengths."""
    n = F.length("word")
    return document_words(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_words"), F.round(F.avg(n), 4).alias("mean_length"), F.round(F.stddev_pop(n), 4).alias("sd_length"))


@query(
    r"SELECT id, CAST(len(regexp_extract_all(evidence.quote, '[\p{L}\p{N}]+')) AS INTEGER) AS n_words, array_to_string(list_transform(regexp_extract_all(evidence.quote, '[\p{L}\p{N}]+'), lambda w, i: '[' || (i - 1) || ']' || w), ' ') AS rendered FROM (SELECT DISTINCT id, evidence FROM relation) WHERE evidence.quote IS NOT NULL"
)
def indexed_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their number before them."""
    w = F.regexp_extract_all("evidence.quote", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    plain = table(spark, sf_dir, "relation").where("evidence.quote IS NOT NULL").select("id", "evidence").distinct()
    return plain.select("id", F.size(w).alias("n_words"), F.array_join(F.transform(w, lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("]"), x)), " ").alias("rendered"))


@query()
def normalized_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words after compatibility composition and case folding, counted; no SQL engine here has both."""
    found = table(spark, sf_dir, "documents").select(F.explode(text.normal_words("text")).alias("word"))
    return found.groupBy("word").agg(F.count("*").alias("n"))


@query()
def word_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of quotes aligned with what was verbatim said, counted by status."""
    pairs = table(spark, sf_dir, "relation").select("id", "evidence.quote", "evidence.verbatim").distinct().where("quote <> verbatim")
    return text.aligned(pairs, "id", "quote", "verbatim").groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_records"))


@query()
def best_match_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best match of each given name among the family names and its lead over the runner-up; both tables are small and do not grow.

    The engine of the SQL measures bytes, not letters, so this is held against a matrix of distances in the tests.
    """
    names = table(spark, sf_dir, "known_name").where("name IS NOT NULL")
    given = names.where("role = 'given'").select(F.lower("name").alias("given")).distinct()
    family = names.where("role = 'family'").select(F.lower("name").alias("family")).distinct()
    score = F.round(1 - F.levenshtein("given", "family") / F.greatest(F.length("given"), F.length("family"), F.lit(1)), 6)
    order = Window.partitionBy("given").orderBy(F.desc("score"), "family")
    ranked = given.crossJoin(family).withColumn("score", score).withColumn("k", F.row_number().over(order)).withColumn("margin", F.round(F.col("score") - F.lead("score").over(order), 6))
    return ranked.where("k = 1").select("given", "family", "score", "margin")


@query(
    r"SELECT kind, CAST(sum(CASE WHEN regexp_full_match(label, '(?i)(?:[{\[]?\s*(?:BR|LG|LS|NS|CG)\s*[}\]]?|sp|sil|SENTENCE[\s_]*(?:START|END))') THEN 1 ELSE 0 END) AS BIGINT) AS n_events, count(*) AS n FROM (SELECT event_type AS kind, CASE CAST(event_id % 5 AS INTEGER) WHEN 0 THEN '{BR}' WHEN 1 THEN 'sil' WHEN 2 THEN 'sentence_start' WHEN 3 THEN event_type ELSE 'brook' END AS label FROM events) GROUP BY kind"
)
def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval labels that are events, not words."""
    m = F.col("event_id") % 5
    label = F.when(m == 0, "{BR}").when(m == 1, "sil").when(m == 2, "sentence_start").when(m == 3, F.col("event_type")).otherwise("brook")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), label.alias("label"))
    return rows.groupBy("kind").agg(F.count_if(F.regexp_like("label", F.lit(text.EVENT_LABEL))).alias("n_events"), F.count("*").alias("n"))


QUERIES, ORACLE = catalog.queries, catalog.oracle
