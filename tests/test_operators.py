"""Operators against plain arithmetic."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge import learner
from tallyforge.functions import special as S
from tallyforge.operators import cluster, decompose, forest, huffman, layers, ordering, regression, text, transform, updaters
from tallyforge.sources import files, text_formats


def close(a, b, eps=1e-6):
    """Relative error with both magnitudes below."""
    return abs(a - b) / (abs(a) + abs(b) + eps) < 1e-4


@pytest.fixture(scope="module")
def grid(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(v) for v in r.normal(size=6)], [float(v) for v in r.normal(size=6)]) for i in range(40)]
    return spark.createDataFrame(rows, "id long, a array<double>, b array<double>"), rows


@pytest.mark.parametrize("name", sorted(layers.UNARY))
def test_unary_gradient_is_the_slope(spark, name):
    layer, eps = layers.UNARY[name], 1e-5
    xs = [(x,) for x in (0.3, 0.7, 1.4, 2.2)]
    x = F.col("x")
    df = spark.createDataFrame(xs, "x double").withColumn("y", layer.forward(x))
    got = df.select(layer.backward(x, F.col("y"), F.lit(1.0)), (layer.forward(x + eps) - layer.forward(x - eps)) / (2 * eps)).collect()
    for a, b in got:
        if name not in ("forward", "sign"):
            assert close(a, b)


@pytest.mark.parametrize("name", sorted(layers.BINARY))
def test_binary_gradient_is_the_slope(spark, name):
    layer, eps = layers.BINARY[name], 1e-5
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame([(0.7, 1.9), (2.5, 0.4), (1.2, 1.1)], "a double, b double").withColumn("y", layer.forward(a, b))
    da, db = layer.backward(a, b, F.col("y"), F.lit(1.0))
    for r in df.select(da, (layer.forward(a + eps, b) - layer.forward(a - eps, b)) / (2 * eps), db, (layer.forward(a, b + eps) - layer.forward(a, b - eps)) / (2 * eps)).collect():
        assert close(r[0], r[1]) and close(r[2], r[3])


def test_softmax_sums_to_one(grid):
    df, _ = grid
    assert all(abs(sum(r[0]) - 1) < 1e-12 for r in df.select(layers.softmax(F.transform("a", lambda v: v * 300))).collect())


def test_matmul_transpose_conv(grid):
    df, rows = grid
    got = df.select(layers.matmul(F.col("a"), F.col("b"), 2, 3, 2), layers.transpose(F.col("a"), 2, 3), layers.conv2d(F.col("a"), 2, 3, [[1.0, -1.0]], pad=0)).collect()
    for (m, t, c), (_, a, b) in zip(got, rows):
        a2, b2 = np.array(a).reshape(2, 3), np.array(b).reshape(3, 2)
        assert np.allclose(m, (a2 @ b2).ravel()) and np.allclose(t, a2.T.ravel()) and np.allclose(c, (a2[:, :-1] - a2[:, 1:]).ravel())


def test_special_functions(spark):
    xs = [0.1, 0.5, 1.0, 2.5, 7.0, 40.0]
    x = F.col("x")
    for v, lg, psi, back, e in spark.createDataFrame([(v,) for v in xs], "x double").select("x", S.lgamma(x), S.digamma(x), S.inverse_digamma(S.digamma(x)), S.erfc(x)).collect():
        assert close(lg, math.lgamma(v)) or abs(lg - math.lgamma(v)) < 1e-9
        assert abs(psi - (math.lgamma(v + 1e-5) - math.lgamma(v - 1e-5)) / 2e-5) < 1e-4 * max(1, abs(psi))
        assert close(back, v)
        assert abs(e - math.erfc(v)) < 2e-7


def test_row_numbers_and_running_sums(spark):
    r = random.Random(1)
    rows = [(r.choice([None, 1, 2, 5, 5, 9, 100]), i, r.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(4)
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    got = {x["i"]: x["place"] for x in ordering.row_numbers(df, ("k", "i"), "place").collect()}
    assert got == {x[1]: n for n, x in enumerate(ordered)}
    sums = {x["i"]: x["s"] for x in ordering.running_sums(df, ("k", "i"), F.col("v"), "s").collect()}
    assert sums == {x[1]: int(s) for x, s in zip(ordered, np.cumsum([x[2] for x in ordered]))}
    assert ordering.row_numbers(df.limit(0), ("k", "i"), "place").count() == 0


def test_roll_up_equals_union_at_threshold_one(spark):
    r = random.Random(2)
    t = spark.createDataFrame([(r.randint(0, 9), r.choice("abcde")) for _ in range(300)], "day int, tok string")
    got = {x["tok"]: x["cnt"] for x in text.roll_up(t.withColumn("x", F.lit(1)), "day", F.lit(0), 1).collect()}
    want = {x["tok"]: x["cnt"] for x in text.dictionary(t).collect()}
    assert {k: v for k, v in want.items() if v >= 4} == got


def test_kmeans_and_merge(spark, grid):
    df, rows = grid
    model = {r["cid"]: np.array(r["c"]) for r in cluster.kmeans(df, "id", "a", 3, 4).collect()}
    c = np.array([rows[i][1] for i in range(3)])
    x = np.array([r[1] for r in rows])
    for _ in range(3):
        near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(3)])
    assert all(np.allclose(model[k], c[k]) for k in range(3))


def test_medoid_swap_never_raises_the_cost(spark, grid):
    df, rows = grid
    start = [(i, rows[i][1]) for i in range(3)]
    cost = lambda m: cluster.medoid_cost(df, "a", spark.createDataFrame(m, "cid int, c array<double>")).first()[0]
    assert cost(cluster.medoid_swap(df, "id", "a", start, [(r[0], r[1]) for r in rows[3:12]])) <= cost(start) + 1e-9


@pytest.mark.parametrize("block", [4096, 17])
def test_pam_weighs_every_row(spark, monkeypatch, block):
    monkeypatch.setattr(cluster, "OPTIONS", block)
    x = np.random.default_rng(5).normal(size=(90, 3)) + 5 * (np.arange(90) // 30)[:, None]  # the first rows are all in one group
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    own, changed = [0, 1, 2], True
    while changed:
        changed = False
        for i in range(3):
            costs = [d[:, [*own[:i], n, *own[i + 1 :]]].min(axis=1).sum() for n in range(90)]
            if min(costs) < costs[own[i]] - 1e-9:
                own[i], changed = int(np.argmin(costs)), True
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, a array<double>").repartition(3)
    got = cluster.pam(df, "id", "a", 3)
    assert [c for _, c in got] == [[float(v) for v in x[n]] for n in own] and max(own) > 60
    m = learner.medoids(df, "id", "a", 3, passes=4).train()
    assert abs(m.scores[-1] + d[:, own].min(axis=1).sum()) < 1e-6


def test_svd_ica_cg(grid):
    df, rows = grid
    x = np.array([r[1] for r in rows])
    values, _ = decompose.svd(df, "a", 6, 4, passes=300)
    assert np.allclose(values, np.linalg.svd(x - x.mean(axis=0))[1][:4], rtol=1e-3)
    w = decompose.ica(df, "a", 6, 2, rounds=3)
    y = (x - x.mean(axis=0)) @ w.T
    assert np.allclose(np.cov(y.T), np.eye(2), atol=1e-6)
    a = x.T @ x + np.eye(6)
    assert np.allclose(decompose.conjugate_gradient(a, np.arange(6.0), diagonal=np.diag(a)), np.linalg.solve(a, np.arange(6.0)))


def test_gradient_is_the_slope_of_the_score(spark):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(float(a), float(b), int(a + b > 0)) for a, b in r.normal(size=(50, 2))], "a double, b double, y int")
    for link in ("linear", "logistic"):
        w, eps = [0.3, -0.2, 0.1], 1e-5
        g = regression.gradient(df, ["a", "b"], w, link, "y").first()
        up = regression.gradient(df, ["a", "b"], [w[0] + eps, *w[1:]], link, "y").first()["ll"]
        down = regression.gradient(df, ["a", "b"], [w[0] - eps, *w[1:]], link, "y").first()["ll"]
        assert close(g["g_a"] * (2 if link == "linear" else 1), (up - down) / (2 * eps))


def test_training_lowers_the_loss(spark):
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(float(a), float(b), int(2 * a - b > 0)) for a, b in r.normal(size=(200, 2))], "a double, b double, y int").persist()
    score = lambda w: regression.gradient(df, ["a", "b"], w, "logistic", "y").first()["ll"]
    assert score(regression.train(df, ["a", "b"], "logistic", "y", 8, 0.5)) > score([0.0, 0.0, 0.0]) + 0.2


def test_forest_learns_a_threshold(spark):
    rows = [(i, [float(i % 10), float(i % 7)], "a" if i % 10 < 4 else "b") for i in range(210)]
    df = spark.createDataFrame(rows, "sample long, xs array<double>, label string").persist()
    inner, leaves = forest.grow(df, 2, "label", ["a", "b"], trees=3, depth=2, draws=4)
    votes = forest.predict(df, inner, leaves, 2, 3).join(df.select("sample", "label"), "sample")
    assert votes.agg(F.avg((F.col("vote") == F.col("label")).cast("double"))).first()[0] > 0.95
    assert forest.merge(inner, inner).select("tree").distinct().count() == 2 * inner.select("tree").distinct().count()


def test_huffman():
    c = dict(huffman.codes([("a", 50), ("b", 20), ("c", 20), ("d", 5), ("e", 5)]))
    assert sum(2.0 ** -len(x) for x in c.values()) == 1 and len(c["a"]) == min(map(len, c.values()))
    assert not any(x != y and y.startswith(x) for x in c.values() for y in c.values())


def test_record_files():
    rows = [b"", b"abc", bytes(range(256)) * 3]
    data = files.frame_records(rows)
    assert list(files.records(data)) == rows
    assert files.crc32c(b"123456789") == 0xE3069283
    with pytest.raises(ValueError):
        list(files.records(data[:-1] + bytes([data[-1] ^ 1])))


def test_numbered_files_and_checkpoints(spark, tmp_path):
    for n in (2, 3, 5):
        spark.range(n).write.parquet(f"{tmp_path}/f{n}")
    assert [p[-2:] for p in files.numbered(spark, f"{tmp_path}/f%d", 0)] == ["f2", "f3"]
    with pytest.raises(FileNotFoundError):
        files.numbered(spark, f"{tmp_path}/g%d", 0)
    keep = files.Checkpoints(spark, f"{tmp_path}/m", keep=2)
    for v in range(4):
        keep.save(v, {"v": v}, w=spark.range(v + 1))
    assert keep.versions == [2, 3] and keep.load("w")[0] == {"v": 3} and keep.load("w")[1]["w"].count() == 4


def test_formats(spark):
    lines = spark.createDataFrame([("1\t2.5\tx,y\t03/04/2020 05:06:07",), ("bad",), ("z\t1\t\t99/99/9999 00:00:00",)], "value string")
    got = text_formats.read_delimited(lines, text_formats.parse_spec("int a\ndouble b\nstring c\nmdate d")).collect()
    assert len(got) == 2 and got[0]["a"] == 1 and got[0]["c"] == ["x", "y"] and got[0]["d"].minute == 6 and got[1]["a"] is None and got[1]["d"] is None
    vw = text_formats.read_namespaces(spark.createDataFrame([(1, "1 |a x:2 y |b z:0.5"), (2, "|")], "id long, value string")).collect()
    assert [(r["namespace"], r["name"], r["value"]) for r in vw] == [("a", "x", 2.0), ("a", "y", 1.0), ("b", "z", 0.5)]


def test_zip_refuses_skew(spark):
    with pytest.raises(ValueError):
        transform.zipped(spark.range(3), spark.range(4), "id")


def test_telescoping_and_rates(spark):
    assert updaters.telescope_steps(20) == [1, 2, 3, 5, 8, 11, 17]
    x = spark.createDataFrame([(0.0,), (0.4,), (2.0,)], "x double").select(updaters.interpolated(F.col("x"), [(0.2, 1.0), (0.6, 0.5)]))
    assert [round(r[0], 6) for r in x.collect()] == [1.0, 0.75, 0.5]


def test_hashed_share_of_large_keys(spark):
    keys = [0, 5, -7, 2**31, 90_000 * 100_003 + 7, 2**53 + 1, 2**63 - 1]
    got = {r["k"]: r["s"] for r in spark.createDataFrame([(k,) for k in keys], "k long").select("k", transform.hashed_share(F.col("k"), 0.5).alias("s")).collect()}
    assert got == {k: (k * 1103515245 + 12345) % 2**31 % 1000 < 500 for k in keys}


def test_pam_weighs_medoids_again_only_after_a_swap(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(700, 5)) + 4 * (np.arange(700) // 175)[:, None]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    own, passes, swaps = [0, 1, 2, 3], 0, 1
    while swaps:
        passes, swaps = passes + 1, 0
        for i in range(4):
            costs = np.minimum(d, d[:, [n for j, n in enumerate(own) if j != i]].min(axis=1)[:, None]).sum(axis=0)
            if costs.min() < costs[own[i]] * (1 - 1e-9):
                own[i], swaps = int(costs.argmin()), swaps + 1
    calls, costs_of = [], cluster._option_costs
    monkeypatch.setattr(cluster, "_option_costs", lambda *a: calls.append(a) or costs_of(*a))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, a array<double>").repartition(3)
    assert [c for _, c in cluster.pam(df, "id", "a", 4)] == [[float(v) for v in x[n]] for n in own]
    assert passes > 1 and len(calls) < 4 * passes  # once for each medoid and pass, if every one were weighed apart
    got = costs_of(df, "a", [x[n].tolist() for n in own], [1, 3], x.tolist())
    assert got.shape == (2, 700)
    for row, i in zip(got, (1, 3)):
        assert np.allclose(row, np.minimum(d, d[:, [n for j, n in enumerate(own) if j != i]].min(axis=1)[:, None]).sum(axis=0), rtol=1e-9, atol=0)
