"""The operators' queries on the test tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cross_parse_langid, drr_packing, exact_dedup, fertility_quality, mvh_mixing, nnpu_toxicity, omh_dedup, pii_sanitise, rlz_substring, sst_tokens
from .common import table


def vocabulary_file(name: str) -> str:
    """A public vocabulary; STRADA_TOKENIZERS names another folder than that of the installed package."""
    folder = os.environ.get("STRADA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe() -> sst_tokens.Vocabulary:
    return sst_tokens.Vocabulary(vocabulary_file("byte_bpe_50k.json"), end=0, spaces=True, size=50_257)


def word_bpe() -> sst_tokens.Vocabulary:
    return sst_tokens.Vocabulary(vocabulary_file("word_bpe_49k.json"), end=1, spaces=False, size=49_408)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op2_omh_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh_dedup.classes(table(spark, sf_dir, "documents"))


def _fold(n: int, k: int) -> Column:
    """Whether crc32 of doc_id as text, modulo n, is k."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)) == k, F.lit(False))


def op3_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nnpu_toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _fold(3, 1))


def op4_sst_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst_tokens.read(spark, sst_tokens.write(table(spark, sf_dir, "documents"), byte_bpe()))


def op5_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_sanitise.report(table(spark, sf_dir, "documents"))


def op6_rlz_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz_substring.remove(table(spark, sf_dir, "documents"), keep_text=False)


def op7_fertility_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility_quality.measure(table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))


def op8_mvh_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mvh_mixing.report(table(spark, sf_dir, "documents"))


def op9_cross_parse_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_parse_langid.predict(table(spark, sf_dir, "documents"), _fold(4, 2))


def op10_drr_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drr_packing.pack(table(spark, sf_dir, "documents"), word_bpe()).drop("source", "ids")


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5's base spans, counted by kind."""
    return pii_sanitise.base_counts(table(spark, sf_dir, "documents"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7's base columns."""
    every = fertility_quality.measure(table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))
    return every.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8's sizes and targets."""
    made = mvh_mixing.plan(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


OP1_SQL = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


OP6_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


PII_SQL = r"""
WITH m AS (
  SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS ip,
         regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+') AS card, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') AS phone
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), d AS (
  SELECT doc_id, email, ip, list_filter(list_transform(card, lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: len(x) BETWEEN 16 AND 19) AS card,
         list_transform(phone, lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM m
)
SELECT doc_id, len(email)::BIGINT AS n_email,
  len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda y: len(ltrim(y, '0')) > 3 OR coalesce(try_cast(ltrim(y, '0') AS INT), 0) > 255)) = 0))::BIGINT AS n_ip,
  len(list_filter(card, lambda x: list_sum(list_transform(range(len(x)), lambda i:
    x[len(x) - i]::INT * (1 + i % 2) - CASE WHEN x[len(x) - i]::INT * (1 + i % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(phone, lambda x: len(x) BETWEEN 8 AND 15))::BIGINT AS n_phone
FROM d
"""

QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id
), c AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars,
         len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN lines USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""

# A source is full at the level (words a unit of weight) 3 n / w; what the full ones give up raises the level of the others.
TARGETS_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS n, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source
), l AS (
  SELECT *, 3 * n / w::DOUBLE AS full_at, sum(n) OVER () AS every, sum(w) OVER () AS weights,
         coalesce(sum(3 * n) OVER o, 0) AS before, coalesce(sum(w) OVER o, 0) AS w_before FROM s WINDOW o AS (ORDER BY 3 * n / w::DOUBLE, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min((every - before) / (weights - w_before)::DOUBLE, full_at) FILTER (every - before <= full_at * (weights - w_before)) AS x FROM l
)
SELECT doc_id, size, l.n AS source_size, round(least(3 * l.n, w * x)::DOUBLE, 3) AS target FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source, level
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_omh_dedup, op3_nnpu_toxicity, op4_sst_tokens, op5_pii_sanitise, op6_rlz_substring, op7_fertility_quality, op8_mvh_mixing, op9_cross_parse_langid, op10_drr_packing, pii_base_counts, quality_base_counts, mixing_targets)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op6_rlz_substring": OP6_SQL, "pii_base_counts": PII_SQL, "quality_base_counts": QUALITY_SQL, "mixing_targets": TARGETS_SQL}
