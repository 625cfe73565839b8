"""The queries of the numbered operators, with SQL where SQL expresses one."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii, secrets
from .align import alignment
from .codes import ENTRIES, PARTS, ROUNDS, SCALE, vector_codes
from .decontam import contamination
from .html import main_text
from .language import identify
from .licenses import find_licenses
from .lm import pseudo_likelihood
from .mixing import entropy_mix
from .neighbours import nearest
from .quality import BROKEN_OFF, BULLET, ENDED, FEWEST_LINES, RULES, SHORT, STOP_WORDS, quality_rules
from .simhash import simhash_groups


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    judged = quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(_table(spark, sf_dir, "pages"))


def _digest(spans: str):
    """The digest of an array of (start, end, kind)."""
    return F.sha2(pii.joined(spans), 256)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    counts = [pii.count_of("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, _digest("base").alias("base_sha256"), pii.joined("spans").alias("spans"))


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every document."""
    return pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op6_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in a mix of sources."""
    return entropy_mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash_groups(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "n_links")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return identify(_table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = pii.find_personal(_table(spark, sf_dir, "documents"))
    counts = [pii.count_of("base", k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, _digest("base").alias("base_sha256"), pii.joined("spans").alias("spans"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document."""
    found = find_licenses(_table(spark, sf_dir, "documents"))
    hits = F.transform("hits", lambda h: F.concat_ws(":", h["license"], h["at"].cast("string"), h["changed"].cast("string")))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"), F.array_join(hits, ",").alias("hits"))


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two tokenizers over every document."""
    return alignment(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of every vector."""
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every row whose id is divisible by 20."""
    return nearest(_table(spark, sf_dir, "embeddings"))


OPERATORS = [op1_decontaminate, op2_quality_rules, op3_html_consensus, op4_secrets, op5_pseudo_likelihood, op6_entropy_mix, op7_simhash, op8_language, op9_personal_data, op10_licenses, op11_align_tokenizers, op12_vector_codes, op13_nearest]


def queries() -> dict:
    import corpus_pipeline

    return {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark),
starts AS (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, 1 + greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM starts),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM places) JOIN windows USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_STOPS = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))
_BROKEN = {
    "mean_word_chars": "word_chars / CAST(nullif(n_words, 0) AS DOUBLE)",
    "symbol_ratio": "n_symbols / CAST(nullif(n_words, 0) AS DOUBLE)",
    "stop_ratio": "n_stop / CAST(nullif(n_words, 0) AS DOUBLE)",
    "dup_line_ratio": "n_dup_lines / CAST(nullif(n_lines, 0) AS DOUBLE)",
    "bullet_line_ratio": "n_bullet / CAST(nullif(n_lines, 0) AS DOUBLE)",
    "ellipsis_line_ratio": "n_ellipsis / CAST(nullif(n_lines, 0) AS DOUBLE)",
    "short_line_ratio": f"CASE WHEN n_lines >= {FEWEST_LINES} THEN n_short / CAST(n_lines AS DOUBLE) END",
    "end_line_ratio": f"CASE WHEN n_lines >= {FEWEST_LINES} THEN n_end / CAST(n_lines AS DOUBLE) END",
}
_KEPT = " AND ".join(f"coalesce({_BROKEN[metric]} {sign} {bound}, TRUE)" for _, metric, least, most in RULES for sign, bound in ((">=", least), ("<=", most)) if bound is not None)



def _quoted(pattern: str) -> str:
    """A Java pattern as an SQL literal that DuckDB reads."""
    return "'" + re.sub(r"\\u([0-9A-F]{4})", lambda m: chr(int(m[1], 16)), pattern).replace("'", "''") + "'"


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
lines AS (SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS n_distinct, count(*) FILTER (regexp_matches(line, {_quoted(BULLET)})) AS n_bullet, count(*) FILTER (regexp_matches(line, {_quoted(BROKEN_OFF)})) AS n_ellipsis,
  count(*) FILTER (length(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) < {SHORT}) AS n_short, count(*) FILTER (regexp_matches(line, {_quoted(ENDED)})) AS n_end FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS n FROM places),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again WHERE n > 1) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_bullet, 0) AS n_bullet, coalesce(n_ellipsis, 0) AS n_ellipsis, coalesce(n_short, 0) AS n_short, coalesce(n_end, 0) AS n_end, CAST(coalesce(n_lines - n_distinct, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_KEPT} AS kept FROM f
"""


def _op12_sql() -> str:
    """Rounds of assigning and averaging, one after another."""
    gap = "list_sum(list_transform(list_zip(parts.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c))))",
        f"parts AS MATERIALIZED (SELECT r, vec_id, label, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) t(p))",
        f"firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES})",
        "b0 AS MATERIALIZED (SELECT p, e, x FROM parts JOIN firsts USING (vec_id))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, p, min(d * {ENTRIES} + e) AS m FROM (SELECT r, p, e, {gap} AS d FROM parts JOIN b{k} b USING (p)) GROUP BY r, p)")
        if k < ROUNDS:
            each = f"SELECT p, m % {ENTRIES} AS e, generate_subscripts(x, 1) AS j, unnest(x) AS c FROM parts JOIN a{k} USING (r, p)"
            means = f"SELECT p, e, list(CAST(floor(total / n) AS BIGINT) ORDER BY j) AS x FROM (SELECT p, e, j, CAST(sum(c) AS DOUBLE) AS total, count(*) AS n FROM ({each}) GROUP BY p, e, j) GROUP BY p, e"
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN ({means}) m ON m.p = b.p AND m.e = b.e)")
    code = f"SELECT r, string_agg('0' || lower(to_hex(m % {ENTRIES})), '' ORDER BY p) AS code, CAST(sum(m // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r"
    book = f"(SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b{ROUNDS})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {book} AS codebooks_sha256 FROM kept JOIN ({code}) USING (r)"


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; the others are tested against brute force or held-out accuracy."""
    return {"op1_decontaminate": OP1_SQL, "op2_quality_rules": OP2_SQL, "op12_vector_codes": _op12_sql()}
