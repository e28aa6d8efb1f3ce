"""Inputs that several plans share, as Spark plans and as the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tokens(spark: SparkSession, d: str, name: str = "documents", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, pos, tok): lower-case runs of a-z, in order."""
    from tallyforge.operators.text import tokenize

    return tokenize(table(spark, d, name), "text", keys)


def token_lists(spark: SparkSession, d: str, name: str = "documents", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, toks): the same tokens, a text's in one array."""
    from tallyforge.operators import text

    return text.token_lists(table(spark, d, name), "text", keys)


def samples(spark: SparkSession, d: str) -> DataFrame:
    """(id, f1, f2, f3, y): an order's mean quantity / 50, discount and tax; y is 1 if any line came back.

    Sums are taken over whole numbers, so that they do not depend on their order."""
    x = table(spark, d, "lineitem")
    n = F.count("*")
    return x.groupBy(F.col("l_orderkey").alias("id")).agg(
        (F.sum(F.col("l_quantity").cast("long")) / (n * F.lit(50.0))).alias("f1"),
        (F.sum(F.round(F.col("l_discount") * 100).cast("long")) / (n * F.lit(100.0))).alias("f2"),
        (F.sum(F.round(F.col("l_tax") * 100).cast("long")) / (n * F.lit(100.0))).alias("f3"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("y"),
    )


SAMPLES = """smp AS (
  SELECT l_orderkey AS id, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / (count(*) * 50.0::DOUBLE) AS f1,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0::DOUBLE) AS f2,
         CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0::DOUBLE) AS f3,
         max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y
  FROM lineitem GROUP BY l_orderkey)"""

TOKENS = """tok AS (
  SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS tok
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS l FROM documents))"""


SENTENCES = """sen AS (
  SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS sent, unnest(l) AS s
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^.!?]+') AS l FROM documents)), stk AS (
  SELECT doc_id, sent, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS tok
  FROM (SELECT doc_id, sent, regexp_extract_all(s, '[a-z]+') AS l FROM sen))"""


def dense(spark: SparkSession, d: str, first: int = 1, n: int = 8, name: str = "x") -> DataFrame:
    """(vec_id, label, x): n embedding coordinates as doubles."""
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", first, n), lambda v: v.cast("double")).alias(name))


#: Embedding coordinates in long form: (vec_id, label, i from 1, x).
LONG = """lng AS (
  SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""


def counts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, tok, cnt)."""
    return tokens(spark, d).groupBy("doc_id", "tok").agg(F.count("*").alias("cnt"))


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """(user, item, rating): customers, parts, whole quantities bought."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).agg(F.sum(F.col("l_quantity").cast("long")).alias("rating"))


RATINGS = """rat AS (
  SELECT o_custkey AS "user", l_partkey AS item, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
