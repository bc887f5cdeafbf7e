"""One query for each operator, over whole tables, and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, bpe, decontaminate, factorisation, language_crf, quality_rules, simhash, substring, token_files, toxicity
from .common import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op2_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(documents(spark, sf_dir)).drop("check")


def op3_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorisation.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.identify(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


OP6_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i : i + 7], ' ') AS key
  FROM item, unnest(range(1, greatest(2, len(w) - 6))) AS t(i) WHERE len(w) > 0
), size AS (SELECT DISTINCT n FROM win), place AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS key
  FROM doc, size, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n
), found AS (SELECT doc_id, i, place.n, item_id FROM place JOIN win USING (key)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
names AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(name, ',' ORDER BY name)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_items, 0) >= 2 AS contaminated
FROM doc d LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)
"""


def base_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_quality_rules that SQL can express."""
    return quality_rules.judge(documents(spark, sf_dir)).drop("kept", "posterior")


def base_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_attention_lm that SQL can express; the model is not trained for them."""
    found = attention_lm.score(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), rounds=0)
    return found.drop("score").withColumn("base_score", F.round("base_score", 4))


def _fold_sql(folds: int) -> str:
    """The remainder of crc32 of the id as text, which DuckDB has no function for: a table of the checksum's 256 steps and a fold over the bytes."""
    return f"""WITH RECURSIVE bits(b, c, k) AS (SELECT b, b, 0 FROM (SELECT unnest(range(256)) AS b) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
steps AS MATERIALIZED (SELECT b, c AS step FROM bits WHERE k = 8), ids AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL),
crc(doc_id, s, i, c) AS (SELECT doc_id, s, 1, 4294967295::BIGINT FROM ids UNION ALL SELECT doc_id, s, i + 1, xor(step, c // 256) FROM crc JOIN steps ON b = xor(c % 256, ascii(substr(s, i, 1))) WHERE i <= length(s)),
fold AS (SELECT doc_id, xor(c, 4294967295::BIGINT) % {folds} AS fold FROM crc WHERE i = length(s) + 1),
"""


BASE_LM_SQL = _fold_sql(10) + attention_lm.BASE_SQL.strip().removeprefix("WITH ")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_compact_windows, op3_attention_lm, op4_token_files, op5_simhash, op6_decontamination, op7_factorisation_machine, op8_language_crf, op9_toxicity, op10_bpe, base_quality_rules, base_attention_lm)}


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": OP6_SQL, "base_quality_rules": quality_rules.BASE_SQL, "base_attention_lm": BASE_LM_SQL}
