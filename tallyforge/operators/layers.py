"""Network layers as column expressions: forward values and backward derivatives.

Element-wise layers work on single columns and are lifted to arrays; structural ones work on arrays. Derivatives follow
ascent: `dy` is the derivative of the objective by the output, what is returned is that by the input."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.arrays import dot, total
from tallyforge.functions.special import logistic, softplus


@dataclass(frozen=True)
class Unary:
    """y = forward(x); dx = backward(x, y, dy)."""

    forward: Callable[[Column], Column]
    backward: Callable[[Column, Column, Column], Column]


@dataclass(frozen=True)
class Binary:
    """y = forward(a, b); da, db = backward(a, b, y, dy)."""

    forward: Callable[[Column, Column], Column]
    backward: Callable[[Column, Column, Column, Column], tuple[Column, Column]]


UNARY = {
    "abs": Unary(F.abs, lambda x, y, dy: dy * F.signum(x)),
    "copy": Unary(lambda x: x, lambda x, y, dy: dy),
    "exp": Unary(F.exp, lambda x, y, dy: dy * y),
    "forward": Unary(lambda x: x, lambda x, y, dy: dy * 0.0),
    "ln": Unary(F.ln, lambda x, y, dy: dy / x),
    "rect": Unary(lambda x: F.greatest(x, F.lit(0.0)), lambda x, y, dy: F.when(x > 0, dy).otherwise(0.0)),
    "sigmoid": Unary(logistic, lambda x, y, dy: dy * y * (1.0 - y)),
    "sign": Unary(F.signum, lambda x, y, dy: dy * 0.0),
    "softplus": Unary(softplus, lambda x, y, dy: dy * logistic(x)),
    "sqrt": Unary(F.sqrt, lambda x, y, dy: dy * 0.5 / y),
    "tanh": Unary(F.tanh, lambda x, y, dy: dy * (1.0 - y * y)),
}

BINARY = {
    "add": Binary(lambda a, b: a + b, lambda a, b, y, dy: (dy, dy)),
    "sub": Binary(lambda a, b: a - b, lambda a, b, y, dy: (dy, -dy)),
    "mul": Binary(lambda a, b: a * b, lambda a, b, y, dy: (dy * b, dy * a)),
    "div": Binary(lambda a, b: a / b, lambda a, b, y, dy: (dy / b, -dy * y / b)),
    "max": Binary(lambda a, b: F.greatest(a, b), lambda a, b, y, dy: (F.when(a >= b, dy).otherwise(0.0), F.when(a >= b, 0.0).otherwise(dy))),
    "min": Binary(lambda a, b: F.least(a, b), lambda a, b, y, dy: (F.when(a <= b, dy).otherwise(0.0), F.when(a <= b, 0.0).otherwise(dy))),
    "power": Binary(lambda a, b: F.pow(a, b), lambda a, b, y, dy: (dy * b * F.pow(a, b - 1.0), dy * y * F.ln(a))),
}


def apply_function(x: Column, f: Callable[[Column], Column]) -> Column:
    """A user's scalar function over an array."""
    return F.transform(x, f)


def apply_function2(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, f)


def softmax(x: Column) -> Column:
    """Shifted by the largest element, so that nothing overflows."""
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / total(e))


def softmax_backward(y: Column, dy: Column) -> Column:
    s = dot(y, dy)
    return F.zip_with(y, dy, lambda p, d: p * (d - s))


def softmax_output(x: Column, target: Column, epsilon: float = 1e-16) -> Column:
    """Log likelihood of the target's place (from 0) under the softmax."""
    shift = F.array_max(x)
    z = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - shift))
    return F.ln(F.exp(F.get(x, target) - shift) / z + epsilon)


def layer_norm(x: Column, n: int, epsilon: float = 1e-4) -> Column:
    mean = total(x) / n
    var = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n
    return F.transform(x, lambda v: (v - mean) / F.sqrt(var + epsilon))


def scale(x: Column, weights: list[float], bias: list[float]) -> Column:
    w, b = (F.array(*[F.lit(float(v)) for v in c]) for c in (weights, bias))
    return F.zip_with(F.zip_with(x, w, lambda p, q: p * q), b, lambda p, q: p + q)


def batch_norm(df: DataFrame, array: str, n: int, epsilon: float = 1e-4) -> DataFrame:
    """Each place of the array by its own mean and deviation over all rows: two numbers a place, broadcast."""
    at = [F.get(array, F.lit(i)) for i in range(n)]
    stats = df.agg(F.array(*[F.avg(a) for a in at]).alias("__m"), F.array(*[F.var_pop(a) for a in at]).alias("__v"))
    j = df.crossJoin(F.broadcast(stats))
    centred = F.zip_with(array, "__m", lambda x, m: x - m)
    return j.withColumn(array, F.zip_with(centred, "__v", lambda x, v: x / F.sqrt(v + epsilon))).drop("__m", "__v")


def lrn_across(x: Column, n: int, size: int = 5, alpha: float = 1.0, beta: float = 0.5, k: float = 2.0) -> Column:
    """Each element over a power of the mean square of its neighbours in the array."""
    half = size // 2

    def one(i: int) -> Column:
        near = [F.get(x, F.lit(j)) for j in range(max(0, i - half), min(n, i + half + 1))]
        return F.get(x, F.lit(i)) / F.pow(k + (alpha / size) * sum((v * v for v in near), F.lit(0.0)), F.lit(beta))

    return F.array(*[one(i) for i in range(n)])


def lrn_within(x: Column, height: int, width: int, size: int = 3, alpha: float = 1.0, beta: float = 0.75, k: float = 1.0) -> Column:
    """Each cell of an image, held row-major, over a power of the mean square of the window around it."""
    half, out = size // 2, []
    for r in range(height):
        for c in range(width):
            near = [F.get(x, F.lit(i * width + j)) for i in range(max(0, r - half), min(height, r + half + 1)) for j in range(max(0, c - half), min(width, c + half + 1))]
            out.append(F.get(x, F.lit(r * width + c)) / F.pow(k + (alpha / (size * size)) * sum((v * v for v in near), F.lit(0.0)), F.lit(beta)))
    return F.array(*out)


def dropout_predict(x: Column, keep: float) -> Column:
    return F.transform(x, lambda v: v * keep)


def dropout_mask(x: Column, key: Column, keep: float) -> Column:
    """Elements kept by a hash of the row's key and their place."""
    return F.transform(x, lambda v, i: F.when(F.pmod((key * 31 + i) * 1103515245 + 12345, F.lit(2147483648)) % 1000 < int(keep * 1000), v).otherwise(0.0))


def one_hot(index: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == index).cast("double"))


def crop(x: Column, first: int, size: int) -> Column:
    return F.slice(x, first + 1, size)


def mirror(x: Column, flag: Column) -> Column:
    return F.when(flag, F.reverse(x)).otherwise(x)


def split_vertical(x: Column, n: int, parts: int) -> list[Column]:
    size = n // parts
    return [F.slice(x, i * size + 1, size) for i in range(parts)]


def matmul(a: Column, b: Column, rows: int, inner: int, cols: int) -> Column:
    """Row-major product of two small matrices held as arrays."""
    cell = lambda r, c: sum((F.get(a, F.lit(r * inner + k)) * F.get(b, F.lit(k * cols + c)) for k in range(inner)), F.lit(0.0))
    return F.array(*[cell(r, c) for r in range(rows) for c in range(cols)])


def transpose(x: Column, rows: int, cols: int) -> Column:
    return F.array(*[F.get(x, F.lit(r * cols + c)) for c in range(cols) for r in range(rows)])


def reformat(x: Column, channels: int, height: int, width: int) -> Column:
    """Channels first to channels last."""
    at = lambda c, h, w: F.get(x, F.lit((c * height + h) * width + w))
    return F.array(*[at(c, h, w) for h in range(height) for w in range(width) for c in range(channels)])


def conv2d(x: Column, height: int, width: int, kernel: list[list[float]], stride: int = 1, pad: int = 0, bias: float = 0.0) -> Column:
    """One channel of a small image held row-major, unrolled into sums."""
    kh, kw = len(kernel), len(kernel[0])
    out = []
    for r in range(-pad, height + pad - kh + 1, stride):
        for c in range(-pad, width + pad - kw + 1, stride):
            terms = [F.get(x, F.lit((r + i) * width + c + j)) * kernel[i][j] for i in range(kh) for j in range(kw) if 0 <= r + i < height and 0 <= c + j < width]
            out.append(sum(terms, F.lit(bias)))
    return F.array(*out)


def pool(x: Column, height: int, width: int, size: int, stride: int, kind: str = "max") -> Column:
    out = []
    for r in range(0, height - size + 1, stride):
        for c in range(0, width - size + 1, stride):
            cells = [F.get(x, F.lit((r + i) * width + c + j)) for i in range(size) for j in range(size)]
            out.append(F.greatest(*cells) if kind == "max" else sum(cells, F.lit(0.0)) / len(cells))
    return F.array(*out)


def lstm_gates(c: Column, i: Column, f: Column, o: Column, g: Column) -> tuple[Column, Column]:
    """New cell and hidden value of one fused step."""
    new = logistic(f) * c + logistic(i) * F.tanh(g)
    return new, logistic(o) * F.tanh(new)


def elastic(x: Column, mean: Column, weight: float) -> Column:
    """Towards the mean of the copies."""
    return (1.0 - weight) * x + weight * mean


def negative_sampling(positive: Column, negatives: Column) -> Column:
    """Log likelihood of a true score and of drawn false ones."""
    return F.ln(logistic(positive)) + F.aggregate(negatives, F.lit(0.0), lambda a, s: a + F.ln(logistic(-s)))


def dense_net(x: Column, weights: list[list[list[float]]], biases: list[list[float]], activation: str = "tanh") -> Column:
    """A small dense network: matrix, bias, activation, and no activation after the last."""
    from tallyforge.functions.arrays import matvec

    for n, (w, b) in enumerate(zip(weights, biases)):
        x = F.zip_with(matvec(w, x), F.array(*[F.lit(float(v)) for v in b]), lambda p, q: p + q)
        if n + 1 < len(weights):
            x = F.transform(x, UNARY[activation].forward)
    return x
