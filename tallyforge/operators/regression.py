"""Generalised linear models and factorisation machines: forward, derivative, likelihood, gradient, fixed passes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.special import logistic
from tallyforge.operators.updaters import adagrad, adagrad_state


@dataclass(frozen=True)
class Link:
    """Prediction from the linear predictor, its derivative and log likelihood against a 0/1 (or real) target."""

    mean: Callable[[Column], Column]
    slope: Callable[[Column, Column], Column]
    score: Callable[[Column, Column], Column]


def _margin_slope(p, t):
    sign = 2 * t - 1
    return F.when(sign * p < 1.0, sign).otherwise(F.lit(0.0))


LINKS = {
    "linear": Link(lambda e: e, lambda p, t: t - p, lambda p, t: -(t - p) * (t - p)),
    "logistic": Link(logistic, lambda p, t: t - p, lambda p, t: F.ln(t * p + (1 - t) * (1 - p) + 1e-20)),
    "maxp": Link(logistic, lambda p, t: (2 * t - 1) * p * (1 - p), lambda p, t: t * p + (1 - t) * (1 - p) - 1),
    "svm": Link(lambda e: e, _margin_slope, lambda p, t: F.least(F.lit(0.0), (2 * t - 1) * p - 1)),
}


def linear(features: list[str], weights: list[float]) -> Column:
    """The linear predictor of dense columns; the last weight is the constant's if there is one more weight."""
    e = F.lit(weights[len(features)]) if len(weights) > len(features) else F.lit(0.0)
    for f, w in zip(features, weights):
        e = e + F.col(f) * w
    return e


def forward(df: DataFrame, features: list[str], weights: list[float], link: str) -> DataFrame:
    return df.withColumn("eta", linear(features, weights)).withColumn("pred", LINKS[link].mean(F.col("eta")))


def gradient(df: DataFrame, features: list[str], weights: list[float], link: str, target: str) -> DataFrame:
    """One row: mean gradient by feature (g_*), and the mean score."""
    p = forward(df, features, weights, link).withColumn("d", LINKS[link].slope(F.col("pred"), F.col(target)))
    out = [F.avg(F.col("d") * F.col(f)).alias(f"g_{f}") for f in features]
    if len(weights) > len(features):
        out.append(F.avg("d").alias("g_const"))
    return p.agg(*out, F.avg(LINKS[link].score(F.col("pred"), F.col(target))).alias("ll"))


def train(df: DataFrame, features: list[str], link: str, target: str, passes: int, rate: float, l2: float = 0.0) -> list[float]:
    """Full-batch ADAGrad passes from zero; one aggregate a pass, the few weights are held by the driver."""
    n = len(features) + 1
    w, ss = [0.0] * n, [0.0] * n
    for step in range(passes):
        g = list(gradient(df, features, w, link, target).first())[:n]
        ss = [(1 - 1 / (step + 1)) * s + x * x / (step + 1) for s, x in zip(ss, g)]
        w = [x + rate * (gx - l2 * x) / (s + 1e-5) ** 0.5 for x, gx, s in zip(w, g, ss)]
    return w


def adagrad_pass(model: DataFrame, grads: DataFrame, step: int, rate: float) -> DataFrame:
    """(key, w, ss) after a step with gradients (key, g): the form for models that do not fit the driver."""
    j = model.join(grads, "key", "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    j = j.withColumn("ss", adagrad_state(F.col("ss"), F.col("g"), step))
    return j.select("key", adagrad(F.col("w"), F.col("g"), F.col("ss"), rate).alias("w"), "ss")


def sparse_gradient(triples: DataFrame, model: DataFrame, targets: DataFrame, link: str) -> DataFrame:
    """(key, g) of sparse samples (sample, key, x), model (key, w), targets (sample, t): two joins and two sums."""
    eta = triples.join(model, "key").groupBy("sample").agg(F.sum(F.col("w") * F.col("x")).alias("eta"))
    d = targets.join(eta, "sample", "left").withColumn("pred", LINKS[link].mean(F.coalesce("eta", F.lit(0.0))))
    d = d.select("sample", LINKS[link].slope(F.col("pred"), F.col("t")).alias("d"))
    return triples.join(d, "sample").groupBy("key").agg(F.sum(F.col("d") * F.col("x")).alias("g"))


def fm_predictor(features: list[str], w: list[float], v1: list[list[float]], v2: list[list[float]], strict: bool = False) -> Column:
    """w.x + |V1 x|^2 - |V2 x|^2; strict leaves out the products of a feature with itself."""
    e = linear(features, w)
    for rows, sign in ((v1, 1.0), (v2, -1.0)):
        for r in rows:
            s = linear(features, r)
            e = e + sign * s * s
            if strict:
                for f, c in zip(features, r):
                    e = e - sign * c * c * F.col(f) * F.col(f)
    return e


def multi_step(triples: DataFrame, targets: DataFrame, model: DataFrame, link: str, rate: float, step: int, l1: float = 0.0, l2: float = 0.0) -> DataFrame:
    """(target, key, w, ss) after a minibatch of sparse samples (sample, key, x) with several targets (sample, target, t):
    ADAGrad on the gradient less the penalties' slopes. Samples without any known feature have a predictor of zero."""
    d = slopes(triples, targets, model, link).select("sample", "target", LINKS[link].slope(F.col("pred"), F.col("t")).alias("d"))
    g = triples.join(d, "sample").groupBy("target", "key").agg(F.sum(F.col("d") * F.col("x")).alias("g"))
    j = model.join(g, ["target", "key"], "left").withColumn("g", F.coalesce("g", F.lit(0.0)) - l1 * F.signum("w") - l2 * F.col("w"))
    j = j.withColumn("ss", adagrad_state(F.col("ss"), F.col("g"), step))
    return j.select("target", "key", adagrad(F.col("w"), F.col("g"), F.col("ss"), rate).alias("w"), "ss")


def slopes(triples: DataFrame, targets: DataFrame, model: DataFrame, link: str) -> DataFrame:
    """targets with pred: the prediction for each sample and target."""
    eta = triples.join(model, "key").groupBy("sample", "target").agg(F.sum(F.col("w") * F.col("x")).alias("eta"))
    return targets.join(eta, ["sample", "target"], "left").withColumn("pred", LINKS[link].mean(F.coalesce("eta", F.lit(0.0)))).drop("eta")


def train_minibatches(triples: DataFrame, targets: DataFrame, model: DataFrame, link: str, batch: Column, batches: int, rate: float, l1: float = 0.0, l2: float = 0.0, held: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The model after one pass over minibatches 0 to batches - 1 of the samples (`batch` is a column of sample), and
    (target, ll) of the batch held out, if one is. Each step's model is written, so that lineage stays one step long."""
    from tallyforge.scratch import kept

    step = 0
    for b in range(batches):
        if b != held:
            step += 1
            model = kept(multi_step(triples.where(batch == b), targets.where(batch == b), model, link, rate, step, l1, l2), "glm-step")
    if held is None:
        return model, None
    p = slopes(triples.where(batch == held), targets.where(batch == held), model, link)
    return model, p.groupBy("target").agg(F.avg(LINKS[link].score(F.col("pred"), F.col("t"))).alias("ll"))


def fm_gradient(df: DataFrame, features: list[str], w: list[float], v1: list[list[float]], v2: list[list[float]], target: str) -> tuple[list[float], list[list[float]], list[list[float]]]:
    """Mean gradients of the logistic score by w (with the constant's last), V1 and V2: one aggregate."""
    d = F.col(target) - logistic(fm_predictor(features, w, v1, v2))
    sums = [F.avg(d * F.col(f)) for f in features] + [F.avg(d)]
    for rows, sign in ((v1, 2.0), (v2, -2.0)):
        sums += [F.avg(d * sign * linear(features, r) * F.col(f)) for r in rows for f in features]
    got = [float(x or 0.0) for x in df.agg(*[c.alias(f"g{i}") for i, c in enumerate(sums)]).first()]
    n, k = len(features), len(v1) * len(features)
    shape = lambda x: [x[i : i + n] for i in range(0, len(x), n)]
    return got[: n + 1], shape(got[n + 1 : n + 1 + k]), shape(got[n + 1 + k :])


def fm_train(df: DataFrame, features: list[str], w: list[float], v1: list[list[float]], v2: list[list[float]], target: str, steps: int, rate: float) -> tuple[list[float], list[list[float]], list[list[float]]]:
    """Full-batch ascent steps of a factorisation machine; the few weights are held by the driver."""
    add = lambda a, b: [x + rate * y for x, y in zip(a, b)]
    for _ in range(steps):
        gw, g1, g2 = fm_gradient(df, features, w, v1, v2, target)
        w, v1, v2 = add(w, gw), [add(a, b) for a, b in zip(v1, g1)], [add(a, b) for a, b in zip(v2, g2)]
    return w, v1, v2


def treatment_effect(df: DataFrame, treated: str, outcome: str, propensity: str, m1: str | None = None, m0: str | None = None, textbook: bool = True) -> DataFrame:
    """(ipw, aipw): propensity-weighted effect, and the effect augmented by outcome models m1 and m0. The form that is
    not textbook adds the two augmentations instead of weighting them by their own arm."""
    t, y, p = F.col(treated), F.col(outcome), F.col(propensity)
    ipw = F.avg(t * y / p - (1 - t) * y / (1 - p))
    if m1 is None:
        return df.agg(ipw.alias("ipw"))
    a, b = F.col(m1), F.col(m0)
    if textbook:
        aug = F.avg(t * y / p - (t - p) / p * a - ((1 - t) * y / (1 - p) + (t - p) / (1 - p) * b))
    else:
        aug = F.avg(t * y / p - (1 - t) * y / (1 - p) - (t - p) * (a / p + b / (1 - p)))
    return df.agg(ipw.alias("ipw"), aug.alias("aipw"))
