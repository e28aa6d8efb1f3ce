"""Next-word networks: a grid of LSTM cells, levels high and a window of words wide, trained through the whole window.

Windows are cut inside the row of a text, so that nothing is shuffled but sums. The weights go to the workers with each
step (their number is checked), which compute over Arrow batches; a step's gradient is one aggregate of as many rows as
there are weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights that a model may have: they are sent to every task and gathered on the driver.
MOST = 4_000_000
#: Windows that a worker computes at once.
BLOCK = 1024


def start(words: int, size: int, levels: int, seed: int = 0, scale: float = 0.1) -> dict:
    """Weights: word vectors "in", a gate matrix and bias a level, output vectors and bias."""
    import numpy as np

    r = np.random.default_rng(seed)
    w = {"in": r.normal(0, scale, (words, size)), "out": r.normal(0, scale, (words, size)), "out_bias": np.zeros(words)}
    for n in range(levels):
        w |= {f"gates{n}": r.normal(0, scale, (4 * size, 2 * size)), f"bias{n}": np.zeros(4 * size)}
    return w


def windows(df: DataFrame, toks: str, words: list[str], width: int) -> DataFrame:
    """(ids): every run of width + 1 words, a window's last word being the next one's first; words outside the list get
    the number after it. A text's last words that fill no window are left out; null texts have none."""
    if len(words) > MOST:
        raise ValueError(f"a list of more than {MOST} words")
    n = F.size(toks)
    cut = df.where(n > width).select(F.explode(F.transform(F.sequence(F.lit(1), n - width, F.lit(width)), lambda i: F.slice(toks, i, width + 1))).alias("ids"))

    def run(batches):
        import pyarrow as pa

        place = {w: i for i, w in enumerate(words)}
        for b in batches:
            lists = b.column(0)
            flat = [place.get(t, len(words)) for t in lists.flatten().to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, width + 1), pa.int32()), pa.array(flat, pa.int32()))], names=["ids"])

    return cut.mapInArrow(run, "ids array<int>")


def pass_through(w: dict, ids, slopes: bool = True):
    """(sum of log likelihoods of all next words, gradients of that sum) of a block of windows."""
    import numpy as np

    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    size, levels, wide, n = w["in"].shape[1], sum(k.startswith("gates") for k in w), ids.shape[1] - 1, len(ids)
    h, c = ([np.zeros((n, size)) for _ in range(levels)] for _ in range(2))
    kept, total, rows = [], 0.0, np.arange(n)
    g = {k: np.zeros_like(v) for k, v in w.items()}
    above: list = []
    for t in range(wide):
        x, cells = w["in"][ids[:, t]], []
        for lv in range(levels):
            both = np.concatenate([x, h[lv]], 1)
            z = both @ w[f"gates{lv}"].T + w[f"bias{lv}"]
            i, f, o, u = sigmoid(z[:, :size]), sigmoid(z[:, size : 2 * size]), sigmoid(z[:, 2 * size : 3 * size]), np.tanh(z[:, 3 * size :])
            old, c[lv] = c[lv], f * c[lv] + i * u
            th = np.tanh(c[lv])
            x = h[lv] = o * th
            cells.append((both, i, f, o, u, old, th))
        kept.append(cells)
        s = x @ w["out"].T + w["out_bias"]
        s -= s.max(1, keepdims=True)
        lse = np.log(np.exp(s).sum(1))
        total += float((s[rows, ids[:, t + 1]] - lse).sum())
        if slopes:
            d = -np.exp(s - lse[:, None])
            d[rows, ids[:, t + 1]] += 1
            g["out"] += d.T @ x
            g["out_bias"] += d.sum(0)
            above.append(d @ w["out"])
    if not slopes:
        return total, g
    dh, dc = ([np.zeros((n, size)) for _ in range(levels)] for _ in range(2))
    for t in reversed(range(wide)):
        dx = above[t]
        for lv in reversed(range(levels)):
            both, i, f, o, u, old, th = kept[t][lv]
            d = dx + dh[lv]
            inner = dc[lv] + d * o * (1 - th * th)
            dz = np.concatenate([inner * u * i * (1 - i), inner * old * f * (1 - f), d * th * o * (1 - o), inner * i * (1 - u * u)], 1)
            g[f"gates{lv}"] += dz.T @ both
            g[f"bias{lv}"] += dz.sum(0)
            back = dz @ w[f"gates{lv}"]
            dx, dh[lv], dc[lv] = back[:, :size], back[:, size:], inner * f
        np.add.at(g["in"], ids[:, t], dx)
    return total, g


def _sums(df: DataFrame, w: dict, slopes: bool) -> DataFrame:
    """(place, value): number of windows at -2, log likelihood at -1, then gradients in the order of the weights."""
    if sum(v.size for v in w.values()) > MOST:
        raise ValueError(f"a model of more than {MOST} weights")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        n, total, g = 0, 0.0, None
        for b in batches:
            lists = b.column(0)
            ids = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else []
            for at in range(0, len(ids), BLOCK):
                s, part = pass_through(w, ids[at : at + BLOCK], slopes)
                g = part if g is None else {k: g[k] + part[k] for k in g}
                n, total = n + len(ids[at : at + BLOCK]), total + s
        values = np.concatenate([[n, total], *([v.ravel() for v in g.values()] if slopes and g else [])])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(values) - 2)), pa.array(values)], names=["place", "value"])

    return df.select("ids").mapInArrow(run, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value"))


def score(df: DataFrame, w: dict) -> tuple[int, float]:
    """Number of windows, and the mean log likelihood of a next word (0 without windows)."""
    r = {x["place"]: x["value"] for x in _sums(df, w, False).collect()}
    n, wide = int(r.get(-2, 0)), df.select(F.max(F.size("ids"))).first()[0]
    return n, r[-1] / (n * (wide - 1)) if n else 0.0


def train(df: DataFrame, w: dict, steps: int, rate: float, epsilon: float = 1e-5) -> dict:
    """Weights after full-batch steps, each coordinate scaled by the root mean square of its gradients so far."""
    import numpy as np

    squares = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(steps):
        r = {x["place"]: x["value"] for x in _sums(df, w, True).collect()}
        if not r.get(-2):
            return w
        at, new = 0, {}
        for k, v in w.items():
            g = np.array([r.get(p, 0.0) for p in range(at, at + v.size)]).reshape(v.shape) / r[-2]
            at += v.size
            squares[k] = (step * squares[k] + g * g) / (step + 1)
            new[k] = v + rate * g / np.sqrt(squares[k] + epsilon)
        w = new
    return w
