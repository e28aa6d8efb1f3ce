"""What collisions keep, and files of named features and matrices."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import collide as C


def energies(df):
    return df.agg(F.sum(F.col("p") * F.col("p")), F.sum(F.col("q") * F.col("q")), F.sum((F.col("p") + F.col("q")) ** 2)).first()


@pytest.mark.parametrize("hardness", [0.0, 0.4, 1.0])
def test_collisions_keep_energy_and_momentum(spark, hardness):
    df = spark.range(50).select(F.col("id").alias("key"), (F.col("id") % 7 - 2.5).alias("p"), (F.col("id") % 5 - 1.5).alias("q"))
    before, apart, together = energies(df), energies(C.collided(df, "p", "q", hardness)), energies(C.collided_together(df, "p", "q", hardness))
    assert apart == pytest.approx(before)
    assert together[0] + together[1] == pytest.approx(before[0] + before[1]) and together[2] == pytest.approx(before[2])
    moved = C.collided(df, "p", "q", hardness).join(df.withColumnsRenamed({"p": "p0", "q": "q0"}), "key").agg(F.max(F.abs(F.col("p") - F.col("p0")))).first()[0]
    assert (moved > 0.1) == (hardness > 0)


def test_particles_at_rest_or_without_rows_stay(spark):
    rest = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], "key long, p double, q double")
    for rule in (C.collided, C.collided_together):
        assert [tuple(r) for r in rule(rest, "p", "q").orderBy("key").collect()] == [(1, 0.0, 0.0), (2, 0.0, 0.0)]
        assert rule(rest.limit(0), "p", "q").count() == 0


def test_examples_round_trip():
    from tallyforge.sources import examples

    made = {"a": {"ints": [1, -1, 300, 1 << 62]}, "b": {"floats": [0.5, -2.0]}, "c": {"bytes": [b"", b"\x00xyz"]}, "": {"ints": []}, "none": None}
    back = examples.decode(examples.encode(made))
    for name, f in made.items():
        want = {"bytes": None, "floats": None, "ints": None} | (f or {})
        assert back[name] == want


def test_features_that_are_not_packed():
    from tallyforge.sources import examples

    one = examples._varint(1 << 3) + examples._varint(7) + examples._varint(1 << 3) + examples._varint(9)  # two whole numbers, each its own field
    entry = examples._field(1, b"x") + examples._field(2, examples._field(3, one))
    assert examples.decode(examples._field(1, examples._field(1, entry)))["x"]["ints"] == [7, 9]
    with pytest.raises(ValueError, match="ends inside"):
        examples.decode(examples._field(1, b"abc")[:-1])


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_matrices_round_trip(kind):
    from tallyforge.sources import matrices

    r, c, v = matrices.cells(matrices.dense_bytes([[1, 2, 3], [4, 5, 6]], 3, kind))
    assert list(zip(r.tolist(), c.tolist(), v.tolist())) == [(0, 0, 1), (1, 0, 2), (2, 0, 3), (0, 1, 4), (1, 1, 5), (2, 1, 6)]
    r, c, v = matrices.cells(matrices.sparse_bytes([[(0, 7), (5, 8)], [], [(2, 9)]], 6, kind))
    assert list(zip(r.tolist(), c.tolist(), v.tolist())) == [(0, 0, 7), (5, 0, 8), (2, 2, 9)]


def test_matrix_files_without_rows(spark, tmp_path):
    from tallyforge.sources import matrices

    none = spark.createDataFrame([], "col long, cells array<struct<row: long, value: double>>")
    assert matrices.write_matrix(none, 4, f"{tmp_path}/m", 8) == 0


@pytest.mark.parametrize("levels", [1, 2])
def test_slopes_of_a_next_word_network(levels):
    import numpy as np

    from tallyforge.operators import language as N

    w = N.start(6, 3, levels, seed=1, scale=0.5)
    ids = np.random.default_rng(2).integers(0, 6, (5, 5))
    _, g = N.pass_through(w, ids)
    for k, v in w.items():
        for at in range(0, v.size, max(1, v.size // 7)):
            ends = []
            for e in (1e-5, -1e-5):
                moved = {n: x.copy() for n, x in w.items()}
                moved[k].flat[at] += e
                ends.append(N.pass_through(moved, ids, False)[0])
            assert g[k].flat[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-4, abs=1e-6)


def test_next_words_of_a_cycle_are_learnt(spark):
    from tallyforge.operators import language as N

    df = spark.createDataFrame([(["a", "b", "c"] * 12,), (["b", "c", "a"] * 9 + ["b"],), (["a"],), ([],), (None,)], "toks array<string>")
    runs = N.windows(df, "toks", ["a", "b", "c"], 4)
    assert runs.count() == 35 // 4 + 27 // 4
    w = N.train(runs, N.start(4, 5, 1), 25, 0.1)
    assert N.score(runs, w)[1] > -0.1
    assert N.score(runs.limit(0), w) == (0, 0.0)
    assert N.windows(df, "toks", [], 4).first()["ids"] == [0, 0, 0, 0, 0]
