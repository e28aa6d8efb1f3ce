"""Update rules: folds over gradients, as column expressions on a model table (key, w, state..., g)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def step_size(rate: float, step: Column, power: float = 0.5, first: float = 1.0, batch: float = 1.0) -> Column:
    """rate / batch * (first / step) ** power."""
    return F.lit(rate / batch) * F.pow(F.lit(first) / step, F.lit(power))


def pass_size(rate: float, number: int, power: float) -> float:
    return rate * (1.0 / (number + 1)) ** power


def sgd(w: Column, g: Column, rate: Column | float, l2: float = 0.0) -> Column:
    """One ascent step, with weight decay."""
    return w + rate * (g - l2 * w)


@dataclass(frozen=True)
class Momentum:
    """decay of the velocity; nesterov looks ahead by it."""

    decay: float
    nesterov: bool = False

    def step(self, w: Column, v: Column, move: Column) -> tuple[Column, Column]:
        """New weight and new velocity."""
        new = self.decay * v + move
        return (w + self.decay * new + move if self.nesterov else w + new), new


def adagrad_state(ss: Column, g: Column, step: int, decay: float | None = None) -> Column:
    """Running mean of squared gradients: weight 1 / (step + 1), or 1 - decay."""
    a = 1.0 / (step + 1) if decay is None else 1.0 - decay
    return (1.0 - a) * ss + a * g * g


def adagrad(w: Column, g: Column, ss: Column, rate: float, power: float = 0.5, epsilon: float = 1e-5) -> Column:
    return w + rate * g / F.pow(ss + epsilon, F.lit(power))


def clip_value(g: Column, limit: float) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), g))


def clip_norm(df: DataFrame, by: str | None, g: str, limit: float) -> DataFrame:
    """Scales gradients whose root mean square (by group, or over all) is above the limit."""
    keys = [by] if by else []
    size = df.groupBy(*keys).agg(F.sqrt(F.avg(F.col(g) * F.col(g))).alias("__rms"))
    j = df.join(size, by) if by else df.crossJoin(F.broadcast(size))
    return j.withColumn(g, F.when(F.col("__rms") > limit, F.col(g) * limit / F.col("__rms")).otherwise(F.col(g))).drop("__rms")


def interpolated(x: Column, points: list[tuple[float, float]], exponential: bool = False) -> Column:
    """A rate that runs through points, straight or along exponentials, and is constant beyond them."""
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        t = (x - x0) / (x1 - x0)
        out = out.when(x <= x1, y0 * F.pow(F.lit(y1 / y0), t) if exponential else y0 + t * (y1 - y0))
    return out.otherwise(F.lit(points[-1][1]))


def exponential_average(df: DataFrame, key: str, order: str, value: str, decay: float) -> DataFrame:
    """(key, average) of an ordered fold m = decay m + (1 - decay) x that starts at the first value: the weights are
    known from the place in the order, so it is a plain sum."""
    w = Window.partitionBy(key)
    placed = df.select(key, F.col(value).alias("__v"), F.row_number().over(w.orderBy(order)).alias("__k"), F.count("*").over(w).alias("__n"))
    weight = F.pow(F.lit(decay), F.col("__n") - F.col("__k")) * F.when(F.col("__k") == 1, 1.0).otherwise(1.0 - decay)
    return placed.groupBy(key).agg(F.sum(weight * F.col("__v")).alias("average"))


def weighted_fold(df: DataFrame, key: str, order: str, value: str, power: float, first: float = 0.99) -> DataFrame:
    """(key, average) of m = (1 - a) m + a x with a = (first / step) ** power, a at most 1 at step 1: an ordered fold over
    one row's array, for series that fit a row (steps of a training pass)."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("xs"))
    start = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("n"))

    def step(acc, x):
        n = acc["n"] + 1
        a = F.pow(F.lit(first) / n, F.lit(power))
        return F.struct(((1 - a) * acc["m"] + a * x["v"]).alias("m"), n.alias("n"))

    return rows.select(key, F.aggregate("xs", start, step, lambda acc: acc["m"]).alias("average"))


def geometric_fold(df: DataFrame, key: str, order: str, value: str, power: float) -> DataFrame:
    """The same fold over logarithms."""
    return weighted_fold(df.withColumn(value, F.ln(value)), key, order, value, power, 1.0).withColumn("average", F.exp("average"))


def telescope_steps(last: int, factor: float = 1.5) -> list[int]:
    """Steps at which an accumulated model is refreshed."""
    out, at = [], 1.0
    while round(at) <= last:
        if not out or round(at) > out[-1]:
            out.append(round(at))
        at *= factor
    return out


def l1(w: Column, weight: float) -> Column:
    return -weight * F.signum(w)


def l2(w: Column, weight: float) -> Column:
    return -weight * w
