"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embeddings import embedding_links
from .html_text import extract_pages
from .lines import MAX_RATIO, drop_site_lines
from .mixing import MAX_EPOCHS, SEED, WEIGHTS, mix_sizes
from .packing import pack_documents
from .quality import HOST_CUT, HOST_DEVIATIONS, MAX_DUP_LINES, MAX_REPEAT_PERCENT, MAX_SYMBOLS_PER_WORD, MIN_STRENGTH, MIN_WORDS, quality_rules
from .secrets import scan_secrets
from .sharding import shard_documents
from .simhash import simhash_components
from .token_counts import token_counts

VOCABULARY = "word_bpe_49k.json"
CONTEXT = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return out.withColumn("over_limit", F.col("n_tokens") > CONTEXT)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(_table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op5_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents")).drop("root", "text_hash")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_site_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_dropped")


def op9_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(_table(spark, sf_dir, "embeddings"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_token_counts, op2_html_extraction, op3_source_mix, op4_secret_scan, op5_prefix_shards, op6_simhash, op7_quality_rules, op8_site_lines, op9_embedding_links, op10_best_fit_packing)
    }


_WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

MIX_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS place
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT *, ([{", ".join(map(str, WEIGHTS))}])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight,
         source_size * {MAX_EPOCHS} AS cap
  FROM totals),
-- sources in the order in which a rising level meets their caps; held and open count what lies below and above
filling AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER w, 0) AS held, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open
  FROM ranked WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT (total - held) / open AS level FROM filling WHERE (total - held) / open * weight <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1),
plan AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * level) AS target,
         CASE WHEN source_size > 0 THEN floor(least(cap::DOUBLE, weight * level) / source_size + 1e-12) ELSE 0 END::BIGINT AS whole
  FROM ranked, level),
placed AS (
  SELECT doc_id, size, place, p.*, target - whole * p.source_size AS extra,
         -- rows at one place have equal texts, so any order of them gives the same rows
         sum(size) OVER (PARTITION BY s.source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target,
       (size * (whole + CASE WHEN upto - size / 2 <= extra THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""

QUALITY_SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
grams AS (
  SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM texts)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT k, count(DISTINCT word) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS word FROM twice) GROUP BY k),
figures AS (
  SELECT k, doc_id, source, len(words) AS n_words,
         coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: trim(x, {_BLANKS}) <> '') AS lines
  FROM texts),
rules AS (
  SELECT f.*, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM figures f LEFT JOIN repeats USING (k)),
judged AS (
  SELECT *, base_failed OR n_symbols > {MAX_SYMBOLS_PER_WORD} * n_words OR n_dup_lines > {MAX_DUP_LINES} * n_lines AS failed FROM rules),
hosts AS (SELECT source, count(*) AS n, sum(failed::INT) AS bad FROM judged GROUP BY source),
moments AS (SELECT sum(bad) / sum(n) AS m, sum(n * (bad / n) * (bad / n)) / sum(n) AS m2 FROM hosts),
spread AS (SELECT m, greatest(m2 - m * m, 1e-9) AS v FROM moments),
prior AS (
  SELECT m, least(greatest(m * (1 - m) / v - 1, {MIN_STRENGTH}), 1e6) AS s,
         round(least(greatest(m + {HOST_DEVIATIONS} * sqrt(v), {HOST_CUT[0]}), {HOST_CUT[1]}), 9) AS host_cut
  FROM spread),
verdicts AS (SELECT source, round((bad + s * m) / (n + s), 9) <= host_cut AS host_kept FROM hosts, prior)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT failed AND host_kept AS kept
FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source
"""

LINES_SQL = f"""
WITH pages AS (SELECT row_number() OVER () AS k, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
each_line AS (SELECT k, source, i, lines[i] AS line, trim(lines[i], {_BLANKS}) AS bare FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM pages)),
totals AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
often AS (
  SELECT e.source, bare FROM each_line e JOIN totals t ON e.source IS NOT DISTINCT FROM t.source
  WHERE bare <> '' GROUP BY e.source, bare, total
  HAVING count(DISTINCT k) > 1 AND count(DISTINCT k) - 1 > {MAX_RATIO}::DOUBLE * (total - 1)),
kept AS (
  SELECT k, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n
  FROM each_line e WHERE NOT EXISTS (SELECT 1 FROM often o WHERE o.source IS NOT DISTINCT FROM e.source AND o.bare = e.bare) GROUP BY k)
SELECT doc_id, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       coalesce(len(lines), 0)::BIGINT AS n_lines, (coalesce(len(lines), 0) - coalesce(n, 0))::BIGINT AS n_dropped
FROM pages p LEFT JOIN kept USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mix": MIX_SQL, "op7_quality_rules": QUALITY_SQL, "op8_site_lines": LINES_SQL}
