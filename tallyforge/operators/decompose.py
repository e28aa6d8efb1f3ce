"""Dense decompositions: moments in Spark, small matrices in numpy on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.linear import gram_arrays


def covariance(df: DataFrame, array: str, n: int) -> DataFrame:
    """(i, j, value), i <= j: sample covariances of array places."""
    at = lambda i: F.get(array, F.lit(i))
    one = df.agg(*[F.covar_samp(at(i), at(j)).alias(f"c_{i}_{j}") for i in range(n) for j in range(i, n)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c_{i}_{j}").alias("value")) for i in range(n) for j in range(i, n)])).alias("t")).select("t.*")


def moments(df: DataFrame, array: str, n: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, sum vector and Gram matrix (n by n numbers, whatever the number of rows)."""
    g = np.zeros((n, n))
    for r in gram_arrays(df, array, n).collect():
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["value"] or 0.0
    s = df.agg(F.count("*").alias("rows"), *[F.sum(F.get(array, F.lit(i))).alias(f"s{i}") for i in range(n)]).first()
    return s["rows"], np.array([s[f"s{i}"] or 0.0 for i in range(n)]), g


def svd(df: DataFrame, array: str, n: int, k: int, centre: bool = True, passes: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors by subspace iteration on the Gram matrix, with a Rayleigh-Ritz step last."""
    rows, s, g = moments(df, array, n)
    if centre and rows:
        g = g - np.outer(s, s) / rows
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((n, k)))[0]
    for _ in range(passes):
        q = np.linalg.qr(g @ q)[0]
    w, v = np.linalg.eigh(q.T @ g @ q)
    order = np.argsort(-w)
    return np.sqrt(np.maximum(w[order], 0)), q @ v[:, order]


#: Contrast functions of independent components: g and its derivative on a projected coordinate.
CONTRASTS = {
    "logcosh": (lambda y: F.tanh(y), lambda y: 1 - F.tanh(y) * F.tanh(y)),
    "exponent": (lambda y: y * F.exp(-y * y / 2), lambda y: (1 - y * y) * F.exp(-y * y / 2)),
    "kurtosis": (lambda y: y * y * y, lambda y: 3 * y * y),
}


def whitening(df: DataFrame, array: str, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and the k by n matrix that makes coordinates uncorrelated with unit variance."""
    rows, s, g = moments(df, array, n)
    mean = s / max(rows, 1)
    w, v = np.linalg.eigh(g / max(rows - 1, 1) - np.outer(mean, mean) * rows / max(rows - 1, 1))
    order = np.argsort(-w)[:k]
    return mean, (v[:, order] / np.sqrt(np.maximum(w[order], 1e-12))).T


def ica(df: DataFrame, array: str, n: int, k: int, contrast: str = "logcosh", rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Unmixing matrix (k by n): fixed-point steps whose expectations are one aggregate a round."""
    from tallyforge.functions.arrays import matvec

    mean, white = whitening(df, array, n, k)
    centred = F.zip_with(F.col(array), F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m)
    z = df.select(matvec(white.tolist(), centred).alias("z")).persist()
    g, dg = CONTRASTS[contrast]
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((k, k)))[0]
    for _ in range(rounds):
        y = z.select("z", matvec(w.tolist(), F.col("z")).alias("y"))
        exprs = [F.avg(g(F.get("y", F.lit(i))) * F.get("z", F.lit(j))).alias(f"m_{i}_{j}") for i in range(k) for j in range(k)] + [F.avg(dg(F.get("y", F.lit(i)))).alias(f"d_{i}") for i in range(k)]
        r = y.agg(*exprs).first()
        new = np.array([[r[f"m_{i}_{j}"] for j in range(k)] for i in range(k)]) - np.diag([r[f"d_{i}"] for i in range(k)]) @ w
        u, _, vt = np.linalg.svd(new)
        w = u @ vt
    z.unpersist()
    return w @ white


def conjugate_gradient(a: np.ndarray, b: np.ndarray, steps: int = 50, tolerance: float = 1e-12, diagonal: np.ndarray | None = None) -> np.ndarray:
    """Solves a x = b for a symmetric positive matrix; `diagonal` preconditions."""
    m = 1.0 / diagonal if diagonal is not None else np.ones(len(b))
    x, r = np.zeros(len(b)), b.astype(float).copy()
    z = m * r
    p, rz = z.copy(), float(r @ z)
    for _ in range(steps):
        if rz <= tolerance:
            break
        ap = a @ p
        alpha = rz / float(p @ ap)
        x, r = x + alpha * p, r - alpha * ap
        z = m * r
        rz, old = float(r @ z), rz
        p = z + rz / old * p
    return x
