"""Pairs of particles: two copies of a model that are trained in turn, whose momenta collide and whose weights attract.

A model table has (key, w, v, w2, v2): weight and momentum of the particle in training and of the one at rest. Every rule
is one aggregate of a row (the inner products of the vectors) and a pass over the table; nothing else leaves the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import sampling

#: Keeps quotients finite where a particle is at rest.
EPSILON = 1e-36


def _products(df: DataFrame, p: str, q: str, key: str, number: int) -> tuple[DataFrame, dict[str, Column]]:
    """df with a standard normal __x a row and the inner products of p, q and x as columns of one broadcast row."""
    r = df.withColumn("__x", sampling.normal(F.col(key), number))
    pairs = {"pp": (p, p), "qq": (q, q), "pq": (p, q), "px": (p, "__x"), "qx": (q, "__x"), "xx": ("__x", "__x")}
    one = r.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)).alias(f"__{n}") for n, (a, b) in pairs.items()])
    return r.crossJoin(F.broadcast(one)), {n: F.col(f"__{n}") for n in pairs}


def collided(df: DataFrame, p: str, q: str, hardness: float = 1.0, key: str = "key", number: int = 0) -> DataFrame:
    """df after a collision in which p + q and the length of each of the two stay: the part of p and -q across their sum
    is turned, by the hardness, into a random direction across both."""
    r, s = _products(df, p, q, key, number)
    det = s["pp"] * s["qq"] - s["pq"] * s["pq"] + EPSILON
    alpha = (s["pq"] * s["qx"] - s["qq"] * s["px"]) / det
    beta = (s["pq"] * s["px"] - s["pp"] * s["qx"]) / det
    whole = s["pp"] + 2 * s["pq"] + s["qq"] + EPSILON
    a, b = (s["pq"] + s["qq"]) / whole, (s["pq"] + s["pp"]) / whole
    energy = a * a * s["pp"] + b * b * s["qq"] - 2 * a * b * s["pq"]
    across = s["xx"] + alpha * s["px"] + beta * s["qx"]  # the squared length of the direction, which is across p and q
    size = F.when((energy > 0) & (across > 0), F.sqrt(energy * (2 * hardness - hardness * hardness) / across)).otherwise(0.0)
    change = hardness * (a * F.col(p) - b * F.col(q)) + size * (F.col("__x") + alpha * F.col(p) + beta * F.col(q))
    return _moved(r.withColumn("__c", change), p, q, df)


def collided_together(df: DataFrame, p: str, q: str, hardness: float = 1.0, key: str = "key", number: int = 0) -> DataFrame:
    """df after a collision in which p + q and the sum of both squared lengths stay: both give way by the hardness, then
    move along a random direction as far as the lost energy allows, forwards or backwards by a draw."""
    r, s = _products(df, p, q, key, number)
    d2 = s["pp"] - 2 * s["pq"] + s["qq"]
    qa = 2 * s["xx"]
    qb = 2 * (1 - hardness) * (s["px"] - s["qx"])
    qc = (hardness * hardness / 2 - hardness) * d2  # what giving way changes in the two squared lengths
    root = qb * qb - 4 * qa * qc
    sign = F.when(sampling.uniform(F.lit("sign"), number) < 0.5, 1.0).otherwise(-1.0)
    far = (-qb + sign * F.sqrt(root)) / (2 * qa + EPSILON)
    change = F.when(root >= 0, hardness / 2 * (F.col(p) - F.col(q)) - far * F.col("__x")).otherwise(0.0)
    return _moved(r.withColumn("__c", change), p, q, df)


def _moved(r: DataFrame, p: str, q: str, like: DataFrame) -> DataFrame:
    return r.withColumn(p, F.col(p) - F.col("__c")).withColumn(q, F.col(q) + F.col("__c")).select(*like.columns)


def attracted(p: Column, q: Column, factor: float) -> tuple[Column, Column]:
    """Both particles, half the factor closer to each other."""
    u = 0.5 * factor * (p - q)
    return p - u, q + u


def pair_step(model: DataFrame, g: str, rate: float, decay: float, step: int, every: int = 2, attraction: float = 0.1, hardness: float = 1.0, apart: bool = True) -> DataFrame:
    """(key, w, v, w2, v2) after a step: the particle in training takes a momentum step along its gradient; at every
    `every`-th step momenta collide (each keeps its own length if `apart`, else both together) and weights attract; then
    the two change places."""
    m = model.withColumn("v", decay * F.col("v") + rate * F.col(g)).withColumn("w", F.col("w") + F.col("v")).select("key", "w", "v", "w2", "v2")
    if every and step % every == 0:
        m = (collided if apart else collided_together)(m, "v", "v2", hardness, number=step)
        near, far = attracted(F.col("w"), F.col("w2"), attraction)
        m = m.select("key", near.alias("w"), "v", far.alias("w2"), "v2")
    return m.select("key", F.col("w2").alias("w"), F.col("v2").alias("v"), F.col("w").alias("w2"), F.col("v").alias("v2"))
