"""Small networks as directed graphs over array columns: forward, backward and gradient steps.

A graph is a list of nodes in an order in which inputs come first. Rows flow through column expressions; the gradients
of all weights are one aggregate a step (as many numbers as the net has weights), and the weights stay on the driver.
Nodes: Linear (with its own weights), Variable (a trained constant), Unary (any elementwise layer), Add, Mul, Stack, and Compound
(a graph used as one node)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.arrays import matvec, outer
from tallyforge.operators.layers import UNARY

Weights = dict[str, list[float]]


@dataclass
class Node:
    """A layer: its name, the names of its inputs, its kind, sizes, and for a compound the graph inside."""

    name: str
    kind: str
    inputs: tuple[str, ...] = ()
    n_in: int = 0
    n_out: int = 0
    inside: list[Node] = field(default_factory=list)


def flat(nodes: list[Node]) -> list[Node]:
    """Compounds opened: inner names get the compound's name in front, its last node takes the compound's own."""
    out = []
    for n in nodes:
        if n.kind != "compound":
            out.append(n)
            continue
        last, names = n.inside[-1].name, {m.name for m in n.inside}
        own = lambda x: n.name if x == last else f"{n.name}_{x}" if x in names else n.inputs[int(x[2:])]  # noqa: B023, E731
        for m in flat(n.inside):
            out.append(Node(own(m.name), m.kind, tuple(own(i) for i in m.inputs), m.n_in, m.n_out))
    return out


def weight_counts(nodes: list[Node]) -> dict[str, int]:
    """Numbers that each node learns: a linear node's matrix row by row, then its bias."""
    return {n.name: n.n_out * n.n_in + n.n_out if n.kind == "linear" else n.n_out for n in flat(nodes) if n.kind in ("linear", "variable")}


def _matrix(node: Node, w: list[float]) -> tuple[list[list[float]], list[float]]:
    return [w[r * node.n_in : (r + 1) * node.n_in] for r in range(node.n_out)], w[node.n_out * node.n_in :]


def _literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def forward(df: DataFrame, nodes: list[Node], weights: Weights) -> DataFrame:
    """df with a column of each node's output; inputs are columns of df."""
    for n in flat(nodes):
        x = [F.col(i) for i in n.inputs]
        if n.kind == "linear":
            rows, bias = _matrix(n, weights[n.name])
            y = F.zip_with(matvec(rows, x[0]), _literal(bias), lambda a, b: a + b)
        elif n.kind == "variable":
            y = _literal(weights[n.name])
        elif n.kind == "add":
            y = F.zip_with(x[0], x[1], lambda a, b: a + b)
        elif n.kind == "mul":
            y = F.zip_with(x[0], x[1], lambda a, b: a * b)
        elif n.kind == "stack":
            y = F.concat(*x)
        else:
            y = F.transform(x[0], UNARY[n.kind].forward)
        df = df.withColumn(n.name, y)
    return df


def backward(df: DataFrame, nodes: list[Node], weights: Weights, slope: str) -> DataFrame:
    """df with d_<name> of every node and input that the slope (a column of the last node's size) reaches, and g_<name>
    of every node that learns. Slopes of a node that several others read are added up."""
    order = flat(nodes)
    parts: dict[str, list[Column]] = {order[-1].name: [F.col(slope)]}
    for n in reversed(order):
        if n.name not in parts:
            continue
        total = parts[n.name][0]
        for p in parts[n.name][1:]:
            total = F.zip_with(total, p, lambda a, b: a + b)
        d = f"d_{n.name}"
        df = df.withColumn(d, total)
        dy, x = F.col(d), [F.col(i) for i in n.inputs]
        give = lambda i, c: parts.setdefault(n.inputs[i], []).append(c)  # noqa: B023, E731
        if n.kind == "linear":
            rows, _ = _matrix(n, weights[n.name])
            give(0, matvec([list(c) for c in zip(*rows)], dy))
            df = df.withColumn(f"g_{n.name}", F.concat(outer(dy, x[0]), dy))
        elif n.kind == "variable":
            df = df.withColumn(f"g_{n.name}", dy)
        elif n.kind == "add":
            give(0, dy)
            give(1, dy)
        elif n.kind == "mul":
            give(0, F.zip_with(dy, x[1], lambda a, b: a * b))
            give(1, F.zip_with(dy, x[0], lambda a, b: a * b))
        elif n.kind == "stack":
            at = F.lit(1)
            for i, c in enumerate(x):
                give(i, F.slice(dy, at, F.size(c)))
                at = at + F.size(c)
        else:
            layer = UNARY[n.kind]
            give(0, F.transform(F.arrays_zip(x[0].alias("x"), F.col(n.name).alias("y"), dy.alias("dy")), lambda z: layer.backward(z["x"], z["y"], z["dy"])))
    for name, columns in parts.items():
        if name not in {n.name for n in order}:
            total = columns[0]
            for p in columns[1:]:
                total = F.zip_with(total, p, lambda a, b: a + b)
            df = df.withColumn(f"d_{name}", total)
    return df


def gradients(df: DataFrame, nodes: list[Node]) -> Weights:
    """Mean gradient of every weight: one aggregate."""
    counts = weight_counts(nodes)
    row = df.agg(*[F.array(*[F.avg(F.get(f"g_{n}", F.lit(i))) for i in range(k)]).alias(n) for n, k in counts.items()]).first()
    return {n: [float(v or 0.0) for v in row[n]] for n in counts}


def train(df: DataFrame, nodes: list[Node], weights: Weights, slope: Column, steps: int, rate: float) -> Weights:
    """Weights after full-batch ascent steps; `slope` is the derivative of the score by the last node's output."""
    for _ in range(steps):
        moved = backward(forward(df, nodes, weights).withColumn("__slope", slope), nodes, weights, "__slope")
        g = gradients(moved, nodes)
        weights = {n: [w + rate * x for w, x in zip(ws, g[n])] for n, ws in weights.items()}
    return weights


def layer_norm_backward(y: Column, deviation: Column, dy: Column, n: int) -> Column:
    """dx of a row brought to mean 0 and the given deviation (with its epsilon): y is the layer's output."""
    mean = F.aggregate(dy, F.lit(0.0), lambda a, v: a + v) / n
    along = F.aggregate(F.zip_with(dy, y, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v) / n
    return F.zip_with(dy, y, lambda a, b: (a - mean - b * along) / deviation)


def conv2d_backward(dy: Column, height: int, width: int, kernel: list[list[float]]) -> Column:
    """dx of a one-channel convolution without padding, stride 1."""
    kh, kw = len(kernel), len(kernel[0])
    oh, ow = height - kh + 1, width - kw + 1
    out = []
    for r in range(height):
        for c in range(width):
            terms = [F.get(dy, F.lit((r - i) * ow + c - j)) * kernel[i][j] for i in range(kh) for j in range(kw) if 0 <= r - i < oh and 0 <= c - j < ow]
            out.append(sum(terms, F.lit(0.0)))
    return F.array(*out)


def max_pool_backward(x: Column, dy: Column, height: int, width: int, size: int) -> Column:
    """dx of max pooling with a stride of the window's size: each window's slope goes to its first largest cell."""
    out: list[Column] = [F.lit(0.0)] * (height * width)
    for k, (r, c) in enumerate((r, c) for r in range(0, height - size + 1, size) for c in range(0, width - size + 1, size)):
        places = [(r + i) * width + c + j for i in range(size) for j in range(size)]
        top = F.greatest(*[F.get(x, F.lit(p)) for p in places])
        earlier = F.lit(False)
        for p in places:
            hit = (F.get(x, F.lit(p)) == top) & ~earlier
            out[p] = F.when(hit, F.get(dy, F.lit(k))).otherwise(0.0)
            earlier = earlier | hit
    return F.array(*out)


def lstm_backward(c: Column, i: Column, f: Column, o: Column, g: Column, new: Column, dc: Column, dh: Column) -> dict[str, Column]:
    """Slopes by the old cell and the four gates (before their functions) of one fused step; `new` is its new cell."""
    from tallyforge.functions.special import logistic

    si, sf, so, tg, tn = logistic(i), logistic(f), logistic(o), F.tanh(g), F.tanh(new)
    inner = dc + dh * so * (1 - tn * tn)
    return {"c": inner * sf, "i": inner * tg * si * (1 - si), "f": inner * c * sf * (1 - sf), "o": dh * tn * so * (1 - so), "g": inner * si * (1 - tg * tg)}


def matmul_backward(a: Column, b: Column, dy: Column, rows: int, inner: int, cols: int) -> tuple[Column, Column]:
    """dA and dB of a row-major product."""
    from tallyforge.operators.layers import matmul, transpose

    return matmul(dy, transpose(b, inner, cols), rows, cols, inner), matmul(transpose(a, rows, inner), dy, inner, rows, cols)
