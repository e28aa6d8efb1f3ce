"""Naive Bayes over counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def naive_bayes_weights(counts: DataFrame, feature: str, value: str, label: str, smooth: float = 0.5) -> DataFrame:
    """(feature, w): log ratio of a feature's smoothed shares in class 1 and class 0."""
    by = counts.groupBy(feature).agg(*[(F.sum(F.when(F.col(label) == k, F.col(value)).otherwise(0)) + smooth).alias(n) for k, n in ((1, "p"), (0, "q"))])
    t = by.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    return by.crossJoin(F.broadcast(t)).select(feature, (F.ln(F.col("p") / F.col("tp")) - F.ln(F.col("q") / F.col("tq"))).alias("w"))


def naive_bayes_scores(counts: DataFrame, weights: DataFrame, sample: str, feature: str, value: str) -> DataFrame:
    """(sample, log_odds)."""
    return counts.join(weights, feature).groupBy(sample).agg(F.sum(F.col("w") * F.col(value)).alias("log_odds"))
