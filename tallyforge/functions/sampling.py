"""Random draws from a row's key: the same key and number give the same draw on every run and in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, number: Column | int = 0) -> Column:
    """In (0, 1): 32 bits of a digest of the key and the draw's number, so that draws of one key are as unrelated as those
    of different keys."""
    n = F.lit(number) if isinstance(number, int) else number
    digest = F.md5(F.concat_ws(":", key.cast("string"), n.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))


def normal(key: Column, number: int = 0) -> Column:
    """Standard normal, from two uniform draws."""
    return F.sqrt(-2 * F.ln(uniform(key, 2 * number))) * F.cos(2 * F.pi() * uniform(key, 2 * number + 1))


def exponential(key: Column, rate: float, number: int = 0) -> Column:
    return -F.ln(uniform(key, number)) / rate


def gamma(key: Column, shape: int, number: int = 0) -> Column:
    """Of a whole shape: a sum of exponential draws."""
    return -F.ln(F.aggregate(F.sequence(F.lit(0), F.lit(shape - 1)), F.lit(1.0), lambda a, i: a * uniform(key, i + number * shape)))


def binomial(key: Column, trials: int, p: float) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.lit(trials - 1)), F.lit(0), lambda a, i: a + (uniform(key, i) < p).cast("int"))


def poisson(key: Column, mean: float) -> Column:
    """The smallest number whose cumulated probability exceeds a uniform draw, summed up to where 1e-12 is left."""
    import math

    u, out, term, total, k = uniform(key), F.lit(0), math.exp(-mean), 0.0, 0
    while total < 1 - 1e-12 and k < 1000:
        total += term
        out = out + (u > total).cast("int")
        k += 1
        term *= mean / k
    return out


def multinomial(key: Column, weights: list[float]) -> Column:
    """A place from 0, drawn with the given weights."""
    u, whole, upto, out = uniform(key), sum(weights), 0.0, F.lit(0)
    for w in weights[:-1]:
        upto += w
        out = out + (u > upto / whole).cast("int")
    return out
