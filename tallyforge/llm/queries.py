"""Thin queries over the operators of this subpackage; SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import classifier, decontamination, licenses, mixing, pii, quality_rules, quality_sql, sharding, simhash, token_counts, token_files
from tallyforge.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op2_byte_prefix_shards")
def op2(spark, sf_dir):
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query("op6_resync_token_counts")
def op6(spark, sf_dir):
    out = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


@_query(
    "op10_source_mix",
    r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         md5(concat_ws(':', CAST(doc_id AS VARCHAR), md5(text))) AS doc_key FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER o, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0)) AS here
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, here * weight >= cap AS filled FROM l),
t AS (
  SELECT source, source_size, CASE WHEN filled THEN cap ELSE weight * (SELECT here FROM f WHERE NOT filled ORDER BY cap / weight LIMIT 1) END AS target FROM f),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5('0:' || d.doc_key), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
""",
)
def op10(spark, sf_dir):
    out = mixing.copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@_query("op4_divergence_rules", quality_sql.judge_sql())
def op4(spark, sf_dir):
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("char_distance", "common_distance")})


@_query("op3_simhash_pivots")
def op3(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@_query("op1_nb_support_vectors")
def op1(spark, sf_dir):
    out = classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@_query("op5_pfor_token_files")
def op5(spark, sf_dir):
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@_query("op7_lstm_crf_pii")
def op7(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@_query("op8_bm25_decontamination")
def op8(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op9_license_dice")
def op9(spark, sf_dir):
    return licenses.scan_licences(table(spark, sf_dir, "documents"))
