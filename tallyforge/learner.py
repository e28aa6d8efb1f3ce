"""Learners: a model, its data, and the passes that train it; predictors apply a trained model to other data.

    learner = kmeans(df, "id", "x", k=8, passes=10).train()
    learner.predict(other)

Each learner holds its options as a frozen dataclass, its state in `model`, and a score for each pass in `scores`.
State that fits the driver (a few weights, k centroids, a tree's nodes) is held there between passes; larger state is a
table that is written once a pass, so that no lineage grows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.arrays import matvec
from tallyforge.operators import cluster, decompose, evaluate, factor, forest, regression
from tallyforge.operators.ordering import row_numbers
from tallyforge.scratch import kept


@dataclass(frozen=True)
class Options:
    passes: int = 2
    rate: float = 1.0
    l2: float = 0.0
    held_out_every: int = 11
    seed: int = 0
    extra: dict = field(default_factory=dict)


class Learner:
    """One way to train: start() gives the state, step(state, number) the next one, score(state) a number, apply(state,
    data) predictions."""

    def __init__(self, data: DataFrame, options: Options, start: Callable[[], Any], step: Callable[[Any, int], Any], apply: Callable[[Any, DataFrame], DataFrame], score: Callable[[Any], float] | None = None):
        self.data, self.options = data, options
        self._start, self._step, self._apply, self._score = start, step, apply, score
        self.model: Any = None
        self.scores: list[float] = []
        self.stopped = False

    def first_pass(self) -> "Learner":
        self.model = self._start()
        return self.next_pass()

    def next_pass(self) -> "Learner":
        self.model = self._step(self.model, len(self.scores))
        self.scores.append(self._score(self.model) if self._score else float("nan"))
        return self

    def train(self, on_pass: Callable[["Learner"], None] | None = None) -> "Learner":
        """All passes; on_pass sees the learner after each and may call stop()."""
        self.scores, self.stopped = [], False
        self.model = self._start()
        for _ in range(self.options.passes):
            if self.stopped:
                break
            self.next_pass()
            if on_pass:
                on_pass(self)
        return self

    def stop(self) -> None:
        self.stopped = True

    def predict(self, data: DataFrame | None = None) -> DataFrame:
        return self._apply(self.model, self.data if data is None else data)

    def describe(self) -> dict:
        return asdict(self.options) | {"scores": self.scores}


def split_held_out(data: DataFrame, order: tuple[str, ...], batch: int, every: int) -> tuple[DataFrame, DataFrame]:
    """(training, held-out) by batches in an order: batch 1, 1 + every, ... is scored only."""
    b = row_numbers(data, order, "__place").withColumn("__batch", F.floor(F.col("__place") / batch) + 1)
    gate = evaluate.held_out(F.col("__batch"), every)
    return b.where(~gate).drop("__place", "__batch"), b.where(gate).drop("__place", "__batch")


def glm(data: DataFrame, features: list[str], target: str, link: str = "logistic", **options) -> Learner:
    """Generalised linear model by full-batch ADAGrad: one aggregate a pass."""
    o = Options(**options)
    n = len(features) + 1

    def step(state, number):
        w, ss = state
        g = list(regression.gradient(data, features, w, link, target).first())[:n]
        ss = [s * number / (number + 1) + x * x / (number + 1) for s, x in zip(ss, g)]
        return [x + o.rate * (gx - o.l2 * x) / (s + 1e-5) ** 0.5 for x, gx, s in zip(w, g, ss)], ss

    return Learner(data, o, lambda: ([0.0] * n, [0.0] * n), step, lambda s, d: regression.forward(d, features, s[0], link), lambda s: regression.gradient(data, features, s[0], link, target).first()["ll"])


def kmeans(data: DataFrame, key: str, array: str, k: int, **options) -> Learner:
    """Lloyd passes after a first pass that only takes the first k samples."""
    spark, schema = data.sparkSession, "cid int, c array<double>"
    table = lambda m: spark.createDataFrame(m, schema)

    def step(model, number):
        if number == 0:
            return model
        new = [(i, list(c)) for i, c in model]
        for r in cluster.lloyd_sums(data, array, np.array([c for _, c in model], float)).collect():  # k rows a coordinate
            new[r["cid"]][1][r["i"]] = r["s"] / r["n"]
        return new

    start = lambda: [(r["cid"], r["c"]) for r in cluster.first_centroids(data, key, array, k).collect()]
    return Learner(data, Options(**options), start, step, lambda m, d: cluster.assign(d, array, table(m)), lambda m: -cluster.assign(data, array, table(m)).agg(F.avg("d2")).first()[0])


def medoids(data: DataFrame, key: str, array: str, k: int, candidates: int | None = None, **options) -> Learner:
    """k-medoids by greedy swaps: every row is a candidate, or the first so many after the k that start."""
    spark = data.sparkSession
    rows = lambda: [(i, r[array]) for i, r in enumerate(data.select(key, array).orderBy(key).limit(k + (candidates or 0)).collect())]
    table = lambda m: spark.createDataFrame(m, "cid int, c array<double>")
    state = rows()
    step = lambda m: cluster.medoid_pass(data, key, array, m)[0] if candidates is None else cluster.medoid_swap(data, key, array, m, state[k:])
    return Learner(data, Options(**options), lambda: state[:k], lambda m, _: step(m), lambda m, d: cluster.assign(d, array, table(m)), lambda m: -cluster.medoid_cost(data, array, table(m)).first()[0])


def topics(triples: DataFrame, k: int, alpha: float = 0.001, beta: float = 0.0001, inner: int = 3, **options) -> Learner:
    """Topic model over counts (doc, term, s): inner document steps, then a model step, a pass."""
    o = Options(**options)

    def start():
        h = lambda i: F.pmod(F.xxhash64("term", F.lit(i + 100 * o.seed)), F.lit(1000)) / 1000.0 + 0.1
        return kept(triples.select("term").distinct().select("term", F.array(*[h(i) for i in range(k)]).alias("m")), "topics")

    def users(model, data):
        u = factor.start_users(data, k)
        for _ in range(inner):
            u = factor.lda_user_step(data, u, model, k, alpha)
        return u

    step = lambda m, _: kept(factor.lda_model_step(triples, users(m, triples), m, k, beta), "topics")
    return Learner(triples, o, start, step, users, lambda m: factor.lda_loglik(triples, users(m, triples), m, k).first()["ll"])


def nmf(triples: DataFrame, k: int, prior: float = 0.01, inner: int = 3, **options) -> Learner:
    """Non-negative factors of counts (doc, term, s)."""

    def start():
        h = lambda i: F.pmod(F.xxhash64("term", F.lit(i)), F.lit(1000)) / 1000.0 + 0.1
        return kept(triples.select("term").distinct().select("term", F.array(*[h(i) for i in range(k)]).alias("m")), "nmf")

    def users(model, data):
        gram = decompose.moments(model, "m", k)[2].tolist()
        u = factor.start_users(data, k)
        for _ in range(inner):
            u = factor.nmf_user_step(data, u, model, gram, prior)
        return u

    def step(model, _):
        u = kept(users(model, triples), "nmf-users")
        gram = decompose.moments(u, "u", k)[2].tolist()
        turned = triples.select(F.col("term").alias("doc"), F.col("doc").alias("term"), "s")
        new = factor.nmf_user_step(turned, model.select(F.col("term").alias("doc"), F.col("m").alias("u")), u.select(F.col("doc").alias("term"), F.col("u").alias("m")), gram, prior)
        return kept(new.select(F.col("doc").alias("term"), F.col("u").alias("m")), "nmf")

    return Learner(triples, Options(**options), start, step, users)


def random_forest(samples: DataFrame, n_features: int, classes: list, trees: int = 20, depth: int = 3, draws: int = 2, gain: float = 0.01, kind: str = "entropy", **options) -> Learner:
    """Forest over (sample, xs, label), grown in its only pass; prediction is the vote of the trees."""
    grow = lambda *_: forest.grow(samples, n_features, "label", classes, trees, depth, draws, gain, kind)
    vote = lambda m, d: evaluate.tally(forest.predict(d, m[0], m[1], depth, trees), "sample", "vote")
    return Learner(samples, Options(**({"passes": 1} | options)), lambda: None, grow, vote)


def svd(data: DataFrame, array: str, n: int, k: int, **options) -> Learner:
    """Leading singular vectors; prediction is the projection on them."""
    return Learner(data, Options(**({"passes": 1} | options)), lambda: None, lambda *_: decompose.svd(data, array, n, k), lambda m, d: d.withColumn("projected", matvec(m[1].T.tolist(), F.col(array))), lambda m: float((m[0] ** 2).sum()))


def ica(data: DataFrame, array: str, n: int, k: int, contrast: str = "logcosh", **options) -> Learner:
    o = Options(**({"passes": 1} | options))
    return Learner(data, o, lambda: None, lambda *_: decompose.ica(data, array, n, k, contrast, seed=o.seed), lambda w, d: d.withColumn("sources", matvec(w.tolist(), F.col(array))))


def ratings(data: DataFrame, rank: int = 8, damp: float = 5.0, **options) -> Learner:
    """Factors of (user, item, rating) around damped means, by alternating least squares; prediction adds the parts."""
    from pyspark.ml.recommendation import ALS

    o = Options(**options)

    def step(*_):
        b = factor.baselines(data, damp)
        rest = b.select("user", "item", (F.col("rating") - F.col("mean") - F.col("item_off") - F.col("user_off")).cast("float").alias("rest"))
        return ALS(rank=rank, maxIter=max(1, o.passes), regParam=max(o.l2, 0.05), userCol="user", itemCol="item", ratingCol="rest", seed=o.seed).fit(rest)

    return Learner(data, Options(**({"passes": 1} | options)), lambda: None, step, lambda m, d: m.transform(d))
