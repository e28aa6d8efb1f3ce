"""Networks, sparse steps, sources and files against plain arithmetic."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import sampling
from tallyforge.functions import special as S
from tallyforge.functions.arrays import packed, unpacked
from tallyforge.operators import cluster, embedding, forest, linear, network, ordering, regression, text
from tallyforge.sources import contracts, files

GRAPH = [
    network.Node("h", "compound", ("x",), inside=[network.Node("lin", "linear", ("in0",), 3, 2), network.Node("act", "sigmoid", ("lin",))]),
    network.Node("k", "linear", ("x",), 3, 2),
    network.Node("v", "variable", (), 0, 2),
    network.Node("m", "mul", ("h", "k")),
    network.Node("a", "add", ("m", "v")),
    network.Node("s", "stack", ("a", "h")),
    network.Node("o", "linear", ("s",), 4, 1),
]


def test_gradients_of_a_graph_are_slopes(spark):
    r = np.random.default_rng(3)
    weights = {n: [float(v) for v in r.normal(size=k)] for n, k in network.weight_counts(GRAPH).items()}
    rows = spark.createDataFrame([([float(v) for v in r.normal(size=3)],) for _ in range(12)], "x array<double>").withColumn("one", F.array(F.lit(1.0)))
    mean = lambda w: rows.transform(lambda d: network.forward(d, GRAPH, w)).agg(F.avg(F.get("o", F.lit(0)))).first()[0]
    moved = network.backward(network.forward(rows, GRAPH, weights), GRAPH, weights, "one")
    got, eps = network.gradients(moved, GRAPH), 1e-5
    for n, ws in weights.items():
        i = int(r.integers(len(ws)))
        up, down = ({**weights, n: [*ws[:i], ws[i] + e, *ws[i + 1 :]]} for e in (eps, -eps))
        assert got[n][i] == pytest.approx((mean(up) - mean(down)) / (2 * eps), abs=1e-6)
    x = moved.select("x", "d_x").first()
    for i in range(3):
        near = [spark.createDataFrame([([v + e * (j == i) for j, v in enumerate(x["x"])],)], "x array<double>") for e in (eps, -eps)]
        up, down = (network.forward(d, GRAPH, weights).select(F.get("o", F.lit(0))).first()[0] for d in near)
        assert x["d_x"][i] == pytest.approx((up - down) / (2 * eps), abs=1e-6)


def test_training_raises_the_score(spark):
    rows = spark.createDataFrame([([math.sin(i), math.cos(i), 1.0], float(math.sin(i) > 0)) for i in range(40)], "x array<double>, y double")
    r = np.random.default_rng(1)
    weights = {n: [float(v) for v in r.normal(size=k)] for n, k in network.weight_counts(GRAPH).items()}
    p = lambda w: network.forward(rows, GRAPH, w).select("y", S.logistic(F.get("o", F.lit(0))).alias("p"))
    score = lambda w: p(w).agg(F.avg(F.ln(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))))).first()[0]
    trained = network.train(rows, GRAPH, weights, F.array(F.col("y") - S.logistic(F.get("o", F.lit(0)))), 4, 0.5)
    assert score(trained) > score(weights)


def test_minibatch_training_holds_a_batch_out(spark):
    r = random.Random(2)
    t = [(s, k, 1.0) for s in range(60) for k in r.sample(range(8), 3)]
    y = [(s, c, float(any(a == s and k == c for a, k, _ in t))) for s in range(60) for c in range(2)]
    frames = [spark.createDataFrame(t, "sample long, key long, x double"), spark.createDataFrame(y, "sample long, target int, t double"), spark.createDataFrame([(c, k, 0.0, 0.0) for c in range(2) for k in range(8)], "target int, key long, w double, ss double")]
    model, held = regression.train_minibatches(*frames, "logistic", F.col("sample") % 6, 6, 0.5, l1=0.001, held=5)
    assert all(x["ll"] > math.log(0.5) for x in held.collect())
    w = {(x["target"], x["key"]): x["w"] for x in model.collect()}
    assert len(w) == 16 and w[0, 0] == max(v for (c, _), v in w.items() if c == 0) and w[1, 1] == max(v for (c, _), v in w.items() if c == 1)


def test_lloyd_sums_and_conjugate_gradient(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 4))
    c = r.normal(size=(3, 4))
    df = spark.createDataFrame([([float(v) for v in row],) for row in x] + [(None,)], "x array<double>").repartition(3)
    near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    got = {(q["cid"], q["i"]): (q["s"], q["n"]) for q in cluster.lloyd_sums(df, "x", c).collect()}
    for k in set(near.tolist()):
        for i in range(4):
            s, n = got[k, i]
            assert n == (near == k).sum() and s == pytest.approx(x[near == k, i].sum())
    a = r.normal(size=(20, 5, 5))
    a = a @ a.transpose(0, 2, 1) + np.eye(5)
    b = r.normal(size=(20, 5))
    assert np.allclose(embedding.conjugate(a, b, 30), np.linalg.solve(a, b[:, :, None])[:, :, 0], atol=1e-6)


def test_ranks_of_many_equal_counts(spark):
    rows = [(f"w{i:05d}", 1 if i % 50 else 2 + i % 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "tok string, cnt long").repartition(5)
    got = {r["tok"]: r["rank"] for r in ordering.rank_by_count(df, "cnt", ("tok",), "rank").collect()}
    assert got == {t: i for i, (t, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}


def test_grams_and_pairs_inside_rows(spark):
    lists = spark.createDataFrame([(1, ["a", "b", "a", "a"]), (2, ["c"]), (3, []), (4, None), (5, ["b", "a"])], "doc long, toks array<string>")
    grams = {tuple(r) for r in text.ngrams(lists, 2, ("doc",)).collect()}
    assert grams == {(1, 1, "a", "b"), (1, 2, "b", "a"), (1, 3, "a", "a"), (5, 1, "b", "a")}
    assert text.ngram_counts(lists, 5).count() == 0
    want: dict = {}
    for toks in (["a", "b", "a", "a"], ["c"], ["b", "a"]):
        for i, x in enumerate(toks):
            for j, y in enumerate(toks):
                if i != j and abs(i - j) <= 2:
                    want[x, y] = want.get((x, y), 0) + 1
    assert {(r["centre"], r["context"]): r["cnt"] for r in text.window_pair_counts(lists, 2).collect()} == want
    assert {(r["centre"], r["context"]): r["n"] for r in text.window_pairs(lists, 2).groupBy("centre", "context").agg(F.count("*").alias("n")).collect()} == want
    before = {(r["doc"], r["pos"]): (r["tok"], r["prev1"], r["prev2"]) for r in text.neighbours(lists, ("doc",)).collect()}
    assert before[1, 0] == ("a", None, None) and before[1, 2] == ("a", "b", "a") and before[5, 1] == ("a", "b", None)


def test_hash_bits_and_packing(spark):
    xs = [-1e30, -7.25, -1.0, -1e-40, 0.0, 1e-3, 0.5, 1.0, 1.9999999, 2.0, 3.14159, 1e20]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(S.ordered_bits(F.col("x"), 20)).collect()]
    assert got == sorted(got)
    bits = [int(np.float32(abs(x)).view(np.uint32)) if abs(x) >= 2.0**-126 else 0 for x in xs]
    assert got == [((-b if x < 0 else b) + (1 << 31)) >> 12 for x, b in zip(xs, bits)]
    row = spark.createDataFrame([(5, 1023, 0)], "a long, b long, c long")
    p = row.select(packed([F.col("a"), F.col("b"), F.col("c")], [20, 10, 4]).alias("p"))
    assert tuple(p.select(*unpacked(F.col("p"), [20, 10, 4])).first()) == (5, 1023, 0)


def test_draws_have_their_moments(spark):
    k = F.col("id")
    r = spark.range(20_000).agg(F.avg(sampling.uniform(k)), F.avg(sampling.normal(k)), F.stddev(sampling.normal(k)), F.avg(sampling.exponential(k, 2.0)), F.avg(sampling.gamma(k, 3)), F.avg(sampling.binomial(k, 8, 0.3)), F.avg(sampling.poisson(k, 2.5)), F.avg((sampling.multinomial(k, [1.0, 2.0, 1.0]) == 1).cast("int"))).first()
    for got, want in zip(r, (0.5, 0.0, 1.0, 0.5, 3.0, 2.4, 2.5, 0.5)):
        assert got == pytest.approx(want, abs=0.08)


def test_records_and_vectors_round_trip(spark, tmp_path):
    rows = [(f"word {i}".encode(),) for i in range(50)] + [(b"",), (None,)]
    assert files.write_records(spark.createDataFrame(rows, "r binary").repartition(3), "r", f"{tmp_path}/records") == 51
    back = sorted(bytes(r["record"]) for r in files.read_records(spark, f"{tmp_path}/records").collect())
    assert back == sorted(r for r, in rows if r is not None)
    vectors = [(f"w{i}é", [float(i), 0.5, -1.0]) for i in range(20)]
    assert files.write_binary_vectors(spark.createDataFrame(vectors, "w string, v array<double>").repartition(3), "w", "v", 3, f"{tmp_path}/vectors") == 20
    assert sorted((r["word"], list(r["vector"])) for r in files.read_binary_vectors(spark, f"{tmp_path}/vectors").collect()) == sorted(vectors)


def test_vector_files_without_words(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit("w"), F.col("id")).alias("w"), F.array(F.col("id").cast("double"), F.lit(0.5)).alias("v"))
    assert files.write_binary_vectors(rows, "w", "v", 2, f"{tmp_path}/vectors") == 5000
    (tmp_path / "vectors/part-000099.bin").write_bytes(b"0 2\n")  # what a split without rows leaves
    back = files.read_binary_vectors(spark, f"{tmp_path}/vectors")
    assert back.where("word = concat('w', int(vector[0])) and size(vector) = 2 and vector[1] = 0.5").select("word").distinct().count() == back.count() == 5000


def test_source_puts_batches_back(spark):
    s = contracts.Source(spark.range(25).withColumnRenamed("id", "k"), ("k",), 10).start()
    first = s.next()
    assert s.progress() == pytest.approx(1 / 3) and first.count() == 10
    s.put_back(first)
    assert [b.agg(F.min("k"), F.max("k")).first()[:] for b in iter(lambda: s.next() if s.has_next() else None, None)] == [(0, 9), (10, 19), (20, 24)]
    assert not contracts.Source(spark.range(0).withColumnRenamed("id", "k"), ("k",), 10).start().has_next()


def test_rest_of_a_source_in_turn(spark):
    source = lambda n: contracts.Source(spark.range(n).withColumnRenamed("id", "k"), ("k",), 10).start()
    turns = lambda df: [r[:] for r in df.groupBy("turn").agg(F.min("k"), F.max("k"), F.count("*")).orderBy("turn").collect()]
    s = source(45)
    first, second = s.next(), s.next()
    s.put_back(second)
    s.put_back(first)
    assert turns(s.rest()) == [(0, 0, 9, 10), (1, 10, 19, 10), (2, 20, 29, 10), (3, 30, 39, 10), (4, 40, 44, 5)]
    assert not s.has_next() and s.progress() == 1.0 and turns(s.rest()) == []
    assert turns(source(0).rest()) == []


def test_jobs_of_src_base_do_not_grow_with_its_batches(spark, tmp_path):
    from tallyforge.plans.catalog import queries

    def jobs(orders, name):
        li = spark.range(orders).selectExpr("id as l_orderkey", "10.0D as l_quantity", "0.1D as l_discount", "0.1D as l_tax", "'R' as l_returnflag")
        li.write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        spark.sparkContext.setJobGroup(name, name)
        rows = queries()["src_base"](spark, f"{tmp_path}/{name}").collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(rows) == orders // 400 + 1 and {r["n"] for r in rows} == {400}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    assert jobs(12_000, "many") <= jobs(800, "few") + 4  # 30 batches and 2


def test_nodes_look_at_a_feature_once(spark):
    s = spark.createDataFrame([(i, 0, 0, [float(i % 3), float(i % 5)], i % 2) for i in range(40)], "sample long, tree int, node long, xs array<double>, label int")
    h = forest.histogram(s, 2, 6, "label")
    assert {r["n"] for r in h.groupBy("feature").agg(F.sum("n").alias("n")).collect()} == {40}


def test_crosses_of_a_hot_sample(spark):
    r = random.Random(4)
    rows = [(0, f, float(f)) for f in r.sample(range(500), 90)] + [(s, f, 1.0 + f) for s in range(1, 6) for f in r.sample(range(20), 5)]
    df = spark.createDataFrame(rows, "s long, f long, v double")
    for self_ in (True, False):
        want = sorted((s, a, b, x * y) for s, a, x in rows for t, b, y in rows if s == t and (a > b or (self_ and a == b)))
        for most in (1024, 16):
            assert sorted(tuple(x) for x in linear.pair_cross(df, "s", "f", "v", self_, most).collect()) == want
