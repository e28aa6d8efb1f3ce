"""Learners train, score and predict."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge import learner as L


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(v) for v in r.normal(size=4) + 6 * (i % 3)], float(i % 3 == 0)) for i in range(120)]
    return spark.createDataFrame(rows, "id long, x array<double>, y double").withColumns({f"f{i}": F.get("x", F.lit(i)) for i in range(4)}).persist()


def test_glm(points):
    m = L.glm(points, ["f0", "f1"], "y", passes=6, rate=0.5).train()
    assert m.scores[-1] > m.scores[0] and m.predict().select("pred").count() == 120
    assert m.describe()["passes"] == 6


def test_kmeans_first_pass_only_starts(points):
    m = L.kmeans(points, "id", "x", 3, passes=5).train()
    assert m.scores[-1] >= m.scores[0] and m.predict().select("cid").distinct().count() == 3
    assert L.kmeans(points, "id", "x", 3).first_pass().model == L.kmeans(points, "id", "x", 3)._start()


def test_stop(points):
    m = L.kmeans(points, "id", "x", 3, passes=9).train(on_pass=lambda x: x.stop() if len(x.scores) == 2 else None)
    assert len(m.scores) == 2


def test_medoids_svd_ica(points):
    m = L.medoids(points, "id", "x", 3, candidates=6, passes=2).train()
    assert m.scores[1] >= m.scores[0]
    assert len(L.svd(points, "x", 4, 2).train().predict().first()["projected"]) == 2
    assert len(L.ica(points, "x", 4, 2).train().predict().first()["sources"]) == 2


def test_factors(spark):
    t = spark.createDataFrame([(d, f"w{(d % 2) * 5 + i}", float(1 + i)) for d in range(12) for i in range(4)], "doc long, term string, s double").persist()
    m = L.topics(t, 2, passes=4).train()
    assert m.scores[-1] > m.scores[0] and m.predict().count() == 12
    assert L.nmf(t, 2, passes=2).train().predict().count() == 12


def test_forest_and_ratings(spark):
    s = spark.createDataFrame([(i, [float(i % 10)], "a" if i % 10 < 5 else "b") for i in range(80)], "sample long, xs array<double>, label string").persist()
    v = L.random_forest(s, 1, ["a", "b"], trees=3, depth=1, draws=1).train().predict().join(s, "sample")
    assert v.where("vote = label").count() > 70
    r = spark.createDataFrame([(u, i, float((u * i) % 5 + 1)) for u in range(8) for i in range(6)], "user int, item int, rating double")
    assert L.ratings(r, rank=2).train().predict().count() == 48


def test_held_out(points):
    train, held = L.split_held_out(points, ("id",), 10, 4)
    assert sorted(r["id"] // 10 for r in held.select("id").distinct().collect()) == sorted([0] * 10 + [4] * 10 + [8] * 10)
    assert train.count() == 90
