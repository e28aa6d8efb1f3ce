"""Quality classifier: naive Bayes support vectors over hashed character n-gram indicators.

An indicator says whether an n-gram (1 to 4 UTF-8 bytes; 4 runs of character classes; 3 signs of whether a word equals
the one before it) occurs in a document. Each is
scaled by the log ratio of its smoothed shares in the two classes; on the scaled, length-normalised rows a linear
hinge-loss model is fitted by dual coordinate descent; margins become probabilities by a logistic curve fitted on
margins of models that did not see the rows.

The fit uses a bounded sample of labelled rows, at most FIT_ROWS, those with the smallest hash of their id; their
indicators (a bit for each of BUCKETS features) are at most FIT_ROWS * BUCKETS / 8 bytes on the driver. Every row of
the corpus is scored, whole.

Defined cases: a null or empty text has no indicator and gets the model's score of nothing; labels that are null are
not used; a row labelled twice counts once with the larger label; if the labelled rows have one class only, or none,
every score is that class's share (0.5 for none); repeated rows are scored each; very long texts are read whole, part by
part, with the features of the whole; empty tables give empty results; further columns, whatever their names, are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import over_batches

BUCKETS = 1 << 16
FIT_ROWS = 6000
_MIX = np.uint32(0x9E3779B1)  # an odd multiplier near 2**32 / golden ratio
#: Byte classes for word shapes: lower, upper, digit, blank, beyond ASCII, and each ASCII mark by itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[[9, 10, 11, 12, 13, 32]] = 32
_SHAPE[128:] = ord("a")


def indicators(text: str | None, step: int = 1 << 20) -> np.ndarray:
    """Sorted bucket numbers of the features of a whole text, read `step` bytes at a time: what a part needs of those
    before it (three bytes, three runs, three words and a word that has not ended) is carried over."""
    data = (text or "").encode("utf-8", "surrogatepass")
    hit = np.zeros(BUCKETS, bool)
    runs, words, tail = np.empty(0, np.uint32), [], b""
    for i in range(0, len(data), step):
        part = data[i : i + step]
        _mark_bytes(np.frombuffer(data[max(0, i - 3) : i + step], np.uint8), hit)
        runs = _mark_runs(runs, np.frombuffer(part, np.uint8), hit)
        words += (tail + part).split()
        tail = words.pop() if words and i + step < len(data) and part[-1] not in b" \t\n\x0b\x0c\r" else b""
        words = _mark_repeats(words, hit)
    return np.flatnonzero(hit)


def _mark_bytes(b: np.ndarray, hit: np.ndarray) -> None:
    """1 to 4 bytes in a row."""
    x = b.astype(np.uint32)
    h = x + np.uint32(1)
    for n in range(1, min(4, len(x)) + 1):
        if n > 1:
            h = h[:-1] * np.uint32(257) + x[n - 1 :] + np.uint32(1)
        hit[((h + np.uint32(n * 0x51ED27)) * _MIX) >> np.uint32(16)] = True


def _mark_runs(before: np.ndarray, b: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Four runs of character classes in a row, `before` being the last runs so far; returns the last three."""
    shape = _SHAPE[b]
    own = shape[np.concatenate([[True], shape[1:] != shape[:-1]])].astype(np.uint32)
    runs = np.concatenate([before, own[1:] if len(before) and before[-1] == own[0] else own])
    if len(runs) >= 4:
        g = ((runs[:-3] * np.uint32(263) + runs[1:-2]) * np.uint32(263) + runs[2:-1]) * np.uint32(263) + runs[3:]
        hit[((g ^ np.uint32(0xA5A5A5)) * _MIX) >> np.uint32(16)] = True
    return runs[-3:]


def _mark_repeats(words: list[bytes], hit: np.ndarray) -> list[bytes]:
    """For four words in a row, which of them equals the one before it; returns the last three words."""
    same = np.fromiter(map(bytes.__eq__, words, words[1:]), np.uint32, max(len(words) - 1, 0))
    if len(same) >= 3:
        hit[((same[:-2] * np.uint32(4) + same[1:-1] * np.uint32(2) + same[2:] + np.uint32(0x5A17)) * _MIX) >> np.uint32(16)] = True
    return words[-3:]


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of the smoothed share of each feature among documents of class 1 over that of class 0."""
    p, q = np.full(BUCKETS, alpha), np.full(BUCKETS, alpha)
    for r, label in zip(rows, y):
        (p if label > 0 else q)[r] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def scaled(row: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Values of a row's features: their ratios, at unit length."""
    v = ratio[row]
    return v / max(float(np.sqrt(v @ v)), 1e-12)


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float = 1.0, passes: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model; classes weigh alike in total.

    Maximises the dual one coefficient at a time: the i-th gradient is y_i w.x_i - 1, the step is clipped to [0, C_i]."""
    rng = np.random.default_rng(seed)
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.array([(y <= 0).mean(), (y > 0).mean()])
    most = c / (2 * share[(y > 0).astype(int)])
    values = [scaled(r, ratio) for r in rows]
    w, bias, a = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            g = sign[i] * (w[r] @ v + bias) - 1
            new = min(max(a[i] - g / (1.0 + (len(v) > 0)), 0.0), most[i])
            if new != a[i]:
                d = (new - a[i]) * sign[i]
                w[r] += d * v
                bias += d
                a[i] = new
    return w, bias


def margin(row: np.ndarray, ratio: np.ndarray, w: np.ndarray, bias: float) -> float:
    return float(w[row] @ scaled(row, ratio)) + bias if len(row) else bias


def logistic_curve(m: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))), by Newton's method with targets drawn slightly inwards."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum(), (p - t).sum()])
        s = p * (1 - p)
        h = np.array([[(s * m * m).sum() + 1e-6, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-9:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, folds: int = 3) -> dict:
    """The model of labelled indicator rows: ratio, weights, bias and the curve from margin to probability."""
    y = np.asarray(y)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return {"constant": share}
    fold = np.arange(len(y)) % folds
    held = np.zeros(len(y))
    for k in range(folds):
        inside = [i for i in range(len(y)) if fold[i] != k]
        if len(set(y[inside].tolist())) < 2:
            continue
        own = [rows[i] for i in inside]
        ratio = log_count_ratio(own, y[inside])
        w, bias = dual_coordinate_descent(own, y[inside], ratio)
        for i in np.flatnonzero(fold == k):
            held[i] = margin(rows[i], ratio, w, bias)
    ratio = log_count_ratio(rows, y)
    w, bias = dual_coordinate_descent(rows, y, ratio)
    a, b = logistic_curve(held, y)
    return {"ratio": ratio.astype(np.float32), "w": w.astype(np.float32), "bias": bias, "a": a, "b": b}


def probability(row: np.ndarray, model: dict) -> float:
    if "constant" in model:
        return model["constant"]
    z = model["a"] * margin(row, model["ratio"], model["w"], model["bias"]) + model["b"]
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(key, folds: int = 5):
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Indicators and labels of at most `most` labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    usable = labels.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null")
    usable = usable.where(~held_out(F.col("k"))).groupBy("k").agg(F.max("y").alias("y"))
    picked = usable.orderBy(F.xxhash64("k"), "k").limit(most).toPandas()  # `most` rows at most
    chosen = spark.createDataFrame(picked, "k long, y int")
    found = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k")

    def make():
        def f(b: pa.RecordBatch):
            bits = []
            for x in b.column("text").to_pylist():
                hit = np.zeros(BUCKETS, np.uint8)
                hit[indicators(x)] = 1
                bits.append(np.packbits(hit).tobytes())
            return {"k": b.column("k"), "y": b.column("y"), "bits": pa.array(bits, pa.binary())}

        return f

    sent = over_batches(found.select("k", "y", "text"), "k long, y int, bits binary", make)
    once = sent.dropDuplicates(["k"]).toPandas().sort_values("k")
    rows = [np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8))) for b in once["bits"]]
    return rows, once["y"].to_numpy()


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, higher: label 1 likelier)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(*training_rows(docs, labels, key, text, label, fit_rows)))  # 0.5 MB

    def make():
        m = model.value

        def f(b: pa.RecordBatch):
            s = [probability(indicators(x), m) for x in b.column("text").to_pylist()]
            return {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": pa.array(s, pa.float64())}

        return f

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    return over_batches(chosen, "doc_id long, held_out boolean, score double", make)
