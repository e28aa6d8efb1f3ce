"""Evaluation of scores and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.ordering import running_sums


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(auc): area under the curve by mean ranks. Ranks come from a table of distinct scores, not of rows."""
    by = df.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    upto = running_sums(by, (score,), F.col("n"), "__upto")
    ranked = upto.withColumn("__rank", F.col("__upto") - F.col("n") + (F.col("n") + 1) / 2)
    s = ranked.agg(F.sum(F.col("__rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return s.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, tpr, fpr) at each distinct score, from the largest."""
    by = df.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    t = by.agg(F.sum("p").alias("__tp"), F.sum("q").alias("__tq"))
    r = running_sums(running_sums(by, (score,), F.col("p"), "__p"), (score,), F.col("q"), "__q").crossJoin(F.broadcast(t))
    above = lambda c: (F.col(f"__t{c}") - F.col(f"__{c}") + F.col(c)) / F.col(f"__t{c}")
    return r.select(score, above("p").alias("tpr"), above("q").alias("fpr"))


def log_loss(y: Column, score: Column, limit: float = 7.0) -> Column:
    """Mean log likelihood of 0/1 labels under the logistic of scores held within the limit."""
    s = F.greatest(F.least(score, F.lit(limit)), F.lit(-limit))
    p = 1.0 / (1.0 + F.exp(-s))
    return F.avg(F.when(y == 1, F.ln(p)).otherwise(F.ln(1.0 - p)))


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(F.avg((a - b) * (a - b)))


def mae(a: Column, b: Column) -> Column:
    return F.avg(F.abs(a - b))


def accuracy(pred: Column, y: Column) -> Column:
    return F.avg((pred == y).cast("double"))


def soft_accuracy(p: Column, y: Column) -> Column:
    return F.avg(p * y + (1.0 - p) * (1.0 - y))


def corpus_perplexity(counts: DataFrame, feature: str, value: str, smooth: float) -> DataFrame:
    """(perplexity): exponential of the entropy of smoothed feature shares."""
    by = counts.groupBy(feature).agg((F.sum(value) + smooth).alias("c"))
    s = by.agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.ln("c")).alias("s"))
    return s.select(F.exp(F.ln("t") - F.col("s") / F.col("t")).alias("perplexity"))


def tally(votes: DataFrame, sample: str, choice: str) -> DataFrame:
    """(sample, choice): the choice with most votes; of equal ones the smallest."""
    n = votes.groupBy(sample, choice).agg(F.count("*").alias("__n"))
    return n.groupBy(sample).agg(F.min_by(F.col(choice), F.struct(-F.col("__n"), F.col(choice))).alias(choice))


def held_out(batch: Column, step: int) -> Column:
    """Whether a batch (from 1) is scored and not trained."""
    return (batch - 1) % step == 0
