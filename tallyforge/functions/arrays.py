"""Array arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def dot(a: Column, b: Column) -> Column:
    return total(hadamard(a, b))


def norm2(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def axpy(k: Column, a: Column, b: Column) -> Column:
    """k a + b."""
    return F.zip_with(a, b, lambda x, y: k * x + y)


def argmax(a: Column) -> Column:
    """Place from 0 of the first largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argmin(a: Column) -> Column:
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def outer(a: Column, b: Column) -> Column:
    """The products of all pairs, b's places running fastest."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def matvec(rows: list[list[float]], x: Column) -> Column:
    """A small fixed matrix times an array."""
    return F.array(*[total(F.zip_with(F.array(*[F.lit(float(v)) for v in r]), x, lambda p, q: p * q)) for r in rows])


def let(value: Column, f) -> Column:
    """f applied to value, which is evaluated once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def packed(fields: list[Column], widths: list[int]) -> Column:
    """Whole numbers side by side in one 64-bit number, the last field lowest: packed numbers sort like the fields."""
    out = F.lit(0).cast("long")
    for f, w in zip(fields, widths):
        out = F.shiftleft(out, w).bitwiseOR(f.cast("long").bitwiseAND(F.lit((1 << w) - 1)))
    return out


def unpacked(x: Column, widths: list[int]) -> list[Column]:
    out, at = [], 0
    for w in reversed(widths):
        out.append(F.shiftright(x, at).bitwiseAND(F.lit((1 << w) - 1)))
        at += w
    return out[::-1]
