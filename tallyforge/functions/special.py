"""Scalar functions that Spark lacks, as column expressions in double arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def logistic(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def guarded_logistic(x: Column, limit: float = 16.0) -> Column:
    """The logistic, exactly 0 or 1 beyond the limit."""
    return F.when(x > limit, F.lit(1.0)).when(x < -limit, F.lit(0.0)).otherwise(1.0 / (1.0 + F.exp(-x)))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log_cosh(x: Column) -> Column:
    a = F.abs(x)
    return a + F.log1p(F.exp(-2.0 * a)) - F.lit(math.log(2.0))


#: Coefficients B_2n / (2n) of the asymptotic series of digamma, with signs.
_PSI = [-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132]
#: Coefficients of the asymptotic series of ln gamma.
_LGAMMA = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680]


def digamma(x: Column) -> Column:
    """psi(x) for x > 0: eight steps of the recurrence up, then the asymptotic series."""
    y = x + 8.0
    r = 1.0 / (y * y)
    series = F.lit(0.0)
    for c in reversed(_PSI):
        series = (series + c) * r
    steps = sum((1.0 / (x + float(i)) for i in range(1, 8)), 1.0 / x)
    return F.ln(y) - 0.5 / y + series - steps


def lgamma(x: Column) -> Column:
    """ln gamma(x) for x > 0: eight steps of the recurrence up, then Stirling's series."""
    y = x + 8.0
    r = 1.0 / (y * y)
    series = F.lit(0.0)
    for c in reversed(_LGAMMA):
        series = series * r + c
    steps = x
    for i in range(1, 8):
        steps = steps * (x + float(i))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series / y - F.ln(steps)


def exp_digamma(x: Column) -> Column:
    return F.exp(digamma(x))


def inverse_digamma(y: Column, steps: int = 6) -> Column:
    """x with psi(x) = y: a start by the two ends' behaviour, then Newton steps with a numeric slope."""
    start = F.when(y >= -2.22, F.exp(y) + 0.5).otherwise(-1.0 / (y + 0.5772156649015329))

    def newton(x, _):
        slope = (digamma(x * 1.0001) - digamma(x)) / (x * 0.0001)
        return F.greatest(x - (digamma(x) - y) / slope, F.lit(1e-10))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, newton)


def erfc(x: Column) -> Column:
    """Complementary error function by Chebyshev-like rational fit (relative error below 1.2e-7)."""
    # Coefficients of the published fit, lowest power first.
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    a = F.abs(x)
    t = 1.0 / (1.0 + 0.5 * a)
    p = F.lit(0.0)
    for k in reversed(c):
        p = p * t + k
    tail = t * F.exp(-a * a + p)
    return F.when(x >= 0, tail).otherwise(2.0 - tail)


def entropy(counts: Column) -> Column:
    """Entropy in nats of an array of non-negative counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    s = F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.ln(c)).otherwise(0.0))
    return F.when(total > 0, F.ln(total) - s / total).otherwise(0.0)


def gini(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    s = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
    return F.when(total > 0, 1.0 - s / (total * total)).otherwise(0.0)


def bits_for(n: int) -> int:
    """Number of bits that hold the values below n."""
    return max(0, (n - 1).bit_length())


def quantised(x: Column, bits: int, low: float, high: float) -> Column:
    """x as a whole number of `bits` bits that keeps the order of values in [low, high]."""
    top = (1 << bits) - 1
    return F.least(F.greatest(F.floor((x - low) / (high - low) * (top + 1)), F.lit(0)), F.lit(top)).cast("long")


def float_bits(x: Column) -> Column:
    """The 32 bits of a single-precision number, without its sign, as a whole number: exponent and fraction. Numbers
    below the smallest normal one are taken as zero."""
    a = F.abs(x.cast("float").cast("double"))
    e = F.floor(F.log2(a))
    e = F.when(a >= F.pow(F.lit(2.0), e + 1), e + 1).when(a < F.pow(F.lit(2.0), e), e - 1).otherwise(e)  # the logarithm is rounded
    bits = (e + 127) * F.lit(1 << 23) + F.round((a / F.pow(F.lit(2.0), e) - 1) * F.lit(float(1 << 23)))
    return F.when(a < 2.0**-126, F.lit(0)).otherwise(bits).cast("long")


def ordered_bits(x: Column, bits: int) -> Column:
    """The top `bits` of a single-precision number's bits, in the order of the numbers: negative ones are mirrored."""
    magnitude = float_bits(x)
    return F.shiftright(F.when(x < 0, -magnitude).otherwise(magnitude) + F.lit(1 << 31), 32 - bits)


def _times32(x: Column, k: int) -> Column:
    """x k modulo 2**32, in halves, so that no product leaves 64 bits."""
    low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftright(x, 16)
    return (low * F.lit(k) + F.shiftleft((high * F.lit(k)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def _turned(x: Column, r: int) -> Column:
    return F.shiftleft(x, r).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.shiftright(x, 32 - r))


def murmur_mix(h: Column, k: Column) -> Column:
    """One mixing step of the 32-bit MurmurHash3, on whole numbers below 2**32."""
    from tallyforge.functions.arrays import let

    # Fixed values of that hash: 0xCC9E2D51, 0x1B873593, 0xE6546B64, turns of 15 and 13.
    mixed = let(_times32(k, 0xCC9E2D51), lambda x: _times32(_turned(x, 15), 0x1B873593))
    return let(h.bitwiseXOR(mixed), lambda x: (_times32(_turned(x, 13), 5) + F.lit(0xE6546B64)).bitwiseAND(F.lit(0xFFFFFFFF)))


def murmur_hash(parts: list[Column], n: int) -> Column:
    """The first key mixed with the others, as a signed 32-bit number, without sign below n."""
    h = parts[0].cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    for p in parts[1:]:
        h = murmur_mix(h, p.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    signed = F.when(h >= F.lit(1 << 31), h - F.lit(1 << 32)).otherwise(h)
    return F.abs(signed % F.lit(n))


def arithmetic_hash(parts: list[Column], n: int) -> Column:
    """A whole-number mix of keys below n, the same in any engine."""
    h = F.lit(0).cast("long")
    for p in parts:
        h = F.pmod((h + p) * F.lit(1103515245) + F.lit(12345), F.lit(2147483648))
    return F.pmod(F.floor(h / 64), F.lit(n))
