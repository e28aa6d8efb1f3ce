"""Word vectors: skip-gram steps with negative pairs, and factor steps of ratings by conjugate gradient."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.arrays import dot
from tallyforge.functions.special import logistic
from tallyforge.operators.factor import array_sum, scaled


def skipgram_step(pairs: DataFrame, words: DataFrame, contexts: DataFrame, k: int, rate: float) -> tuple[DataFrame, DataFrame]:
    """New (centre, v) and (context, c) after one full step over counted pairs (centre, context, n, label): label 1 for pairs
    seen, 0 for drawn ones. Each vector moves along the slope of its own pairs' mean log likelihood."""
    j = pairs.join(words, "centre").join(contexts, "context")
    j = j.withColumn("d", F.col("n") * (F.col("label") - logistic(dot(F.col("v"), F.col("c")))))

    def moved(model, key, own, other):
        g = j.select(key, "n", scaled(F.col("d"), F.col(other)).alias("g")).groupBy(key).agg(array_sum("g", k).alias("g"), F.sum("n").alias("n"))
        new = F.when(F.col("n").isNull(), F.col(own)).otherwise(F.zip_with(own, "g", lambda a, b: a + rate * b / F.col("n")))
        return model.join(g, key, "left").select(key, new.alias(own))

    return moved(words, "centre", "v", "c"), moved(contexts, "context", "c", "v")


def factor_solve(ratings: DataFrame, items: DataFrame, k: int, penalty: float, steps: int | None = None) -> DataFrame:
    """(user, u): each user's factors against the items' (item, m), least squares with a penalty for each rating, by
    conjugate gradient preconditioned with the diagonal. The k by k sums of a user come from one partial aggregate, so a user
    with many ratings is no large group; users are solved in blocks."""
    j = ratings.join(items, "item")
    at = lambda i: F.get("m", F.lit(i))
    sums = j.groupBy("user").agg(F.array(*[F.sum(at(a) * at(b)) for a in range(k) for b in range(k)]).alias("gram"), F.array(*[F.sum(at(a) * F.col("rating")) for a in range(k)]).alias("right"), F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            a = np.array(b.column("gram").to_pylist(), float).reshape(-1, k, k)
            a += penalty * b.column("n").to_numpy()[:, None, None] * np.eye(k)
            u = conjugate(a, np.array(b.column("right").to_pylist(), float), steps or k)
            yield pa.RecordBatch.from_arrays([b.column("user"), pa.array(u.tolist(), pa.list_(pa.float64()))], names=["user", "u"])

    return sums.select(F.col("user").cast("long").alias("user"), "gram", "right", "n").mapInArrow(run, "user long, u array<double>")


def conjugate(a: np.ndarray, b: np.ndarray, steps: int) -> np.ndarray:
    """Solutions of many small positive systems side by side (rows, k, k) and (rows, k)."""
    m = 1.0 / np.einsum("nii->ni", a)
    x, r = np.zeros_like(b), b.copy()
    z = m * r
    p, rz = z.copy(), (r * z).sum(axis=1)
    for _ in range(steps):
        ap = np.einsum("nij,nj->ni", a, p)
        along = (p * ap).sum(axis=1)
        alpha = np.divide(rz, along, out=np.zeros_like(rz), where=along > 0)[:, None]
        x, r = x + alpha * p, r - alpha * ap
        z = m * r
        new = (r * z).sum(axis=1)
        p = z + np.divide(new, rz, out=np.zeros_like(new), where=rz > 0)[:, None] * p
        rz = new
    return x
