"""Network layers over embedding coordinates. Inputs: a is coordinates 1 to 8, b is 9 to 16."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import arrays as A
from tallyforge.operators import layers as L
from tallyforge.plans.catalog import query
from tallyforge.plans.fixtures import LONG, dense, table

TWO = f"{LONG}, two AS (SELECT p.vec_id, p.i, p.x AS a, q.x AS b FROM lng p JOIN lng q ON p.vec_id = q.vec_id AND q.i = p.i + 8 WHERE p.i <= 8)"
SIG = "1 / (1 + exp(-{x}))"

#: Layer: what is fed in for x, y as SQL, dx as SQL (of x, y and dy).
UNARY_SQL = {
    "abs": ("a", "abs(x)", "dy * sign(x)"),
    "copy": ("a", "x", "dy"),
    "exp": ("a", "exp(x)", "dy * y"),
    "forward": ("a", "x", "dy * 0"),
    "ln": ("abs(a) + 0.1", "ln(x)", "dy / x"),
    "rect": ("a", "greatest(x, 0)", "CASE WHEN x > 0 THEN dy ELSE 0 END"),
    "sigmoid": ("a", SIG.format(x="x"), "dy * y * (1 - y)"),
    "sign": ("a", "CAST(sign(x) AS DOUBLE)", "dy * 0"),
    "softplus": ("a", "ln(1 + exp(x))", "dy * " + SIG.format(x="x")),
    "sqrt": ("abs(a) + 0.1", "sqrt(x)", "dy * 0.5 / y"),
    "tanh": ("a", "tanh(x)", "dy * (1 - y * y)"),
}

for _name, (_x, _y, _dx) in UNARY_SQL.items():

    @query(f"layer_{_name}", f"WITH {TWO}, i AS (SELECT vec_id, i, {_x} AS x, b AS dy FROM two), o AS (SELECT *, {_y} AS y FROM i) SELECT vec_id, i, round(y, 7) + 0.0::DOUBLE AS y, round({_dx}, 7) + 0.0::DOUBLE AS dx FROM o")
    def _unary(spark, d, name=_name, positive=_x != "a"):
        layer = L.UNARY[name]
        e = two(spark, d)
        x = F.transform("a", lambda v: F.abs(v) + 0.1) if positive else F.col("a")
        e = e.select("vec_id", x.alias("x"), F.col("b").alias("dy")).withColumn("y", F.transform("x", layer.forward))
        e = e.withColumn("dx", F.transform(F.arrays_zip("x", "y", "dy"), lambda z: layer.backward(z["x"], z["y"], z["dy"])))
        return spread(e, "y", "dx")


def two(spark, d):
    e = dense(spark, d, 1, 16)
    return e.select("vec_id", "label", F.slice("x", 1, 8).alias("a"), F.slice("x", 9, 8).alias("b"))


def spread(df, *arrays, key="vec_id", digits=7):
    """A row for each place, numbers from 1, rounded."""
    z = df.select(key, F.posexplode(F.arrays_zip(*arrays)).alias("i", "z"))
    return z.select(key, (F.col("i") + 1).alias("i"), *[(F.round(F.col(f"z.{a}"), digits) + 0.0).alias(a) for a in arrays])


#: Layer: a, b as fed in, y, da, db as SQL; dy is 1 + i / 10.
BINARY_SQL = {
    "add": ("a", "b", "a + b", "dy", "dy"),
    "sub": ("a", "b", "a - b", "dy", "-dy"),
    "mul": ("a", "b", "a * b", "dy * b", "dy * a"),
    "div": ("a", "abs(b) + 0.5", "a / b", "dy / b", "-dy * y / b"),
    "max": ("a", "b", "greatest(a, b)", "CASE WHEN a >= b THEN dy ELSE 0 END", "CASE WHEN a >= b THEN 0 ELSE dy END"),
    "min": ("a", "b", "least(a, b)", "CASE WHEN a <= b THEN dy ELSE 0 END", "CASE WHEN a <= b THEN 0 ELSE dy END"),
    "power": ("abs(a) + 0.5", "b", "pow(a, b)", "dy * b * pow(a, b - 1)", "dy * y * ln(a)"),
}

for _name, (_a, _b, _y, _da, _db) in BINARY_SQL.items():

    @query(f"layer_{_name}", f"WITH {TWO}, i AS (SELECT vec_id, i, {_a} AS a, {_b} AS b, 1 + i / 10.0::DOUBLE AS dy FROM two), o AS (SELECT *, {_y} AS y FROM i) SELECT vec_id, i, round(y, 7) + 0.0::DOUBLE AS y, round({_da}, 7) + 0.0::DOUBLE AS da, round({_db}, 7) + 0.0::DOUBLE AS db FROM o")
    def _binary(spark, d, name=_name, fa=_a, fb=_b):
        layer = L.BINARY[name]
        lift = lambda c, f: F.transform(c, lambda v: F.abs(v) + 0.5) if f.startswith("abs") else F.col(c)
        e = two(spark, d).select("vec_id", lift("a", fa).alias("a"), lift("b", fb).alias("b"))
        e = e.withColumn("dy", F.transform("a", lambda v, i: 1.0 + (i + 1) / F.lit(10.0))).withColumn("y", F.zip_with("a", "b", layer.forward))
        z = F.arrays_zip("a", "b", "y", "dy")
        back = lambda k: F.transform(z, lambda t: layer.backward(t["a"], t["b"], t["y"], t["dy"])[k])
        return spread(e.withColumn("da", back(0)).withColumn("db", back(1)), "y", "da", "db")


A8 = f"{LONG}, e AS (SELECT vec_id, label, i, x FROM lng WHERE i <= 8)"


@query("layer_softmax", f"WITH {TWO}, s AS (SELECT vec_id, i, exp(a) / sum(exp(a)) OVER (PARTITION BY vec_id) AS y, b AS dy FROM two) SELECT vec_id, i, round(y, 7) AS y, round(y * (dy - sum(y * dy) OVER (PARTITION BY vec_id)), 7) + 0.0::DOUBLE AS dx FROM s")
def layer_softmax(spark, d):
    e = two(spark, d).withColumn("y", L.softmax(F.col("a")))
    return spread(e.withColumn("dx", L.softmax_backward(F.col("y"), F.col("b"))), "y", "dx")


@query("layer_softmaxx", f"WITH {A8} SELECT vec_id, i, round(exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id, (i - 1) // 4), 7) AS y FROM e")
def layer_softmaxx(spark, d):
    """Softmax over groups of four places."""
    e = dense(spark, d, 1, 8)
    return spread(e.select("vec_id", F.concat(L.softmax(F.slice("x", 1, 4)), L.softmax(F.slice("x", 5, 4))).alias("y")), "y")


@query("layer_softmax_output", f"WITH {A8}, s AS (SELECT vec_id, label, i, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p, max(x) OVER (PARTITION BY vec_id) = x AS top FROM e) SELECT vec_id, round(ln(p + 1e-16), 6) AS ll, CAST(top AS INTEGER) AS hit FROM s WHERE i = label % 8 + 1")
def layer_softmax_output(spark, d):
    e = dense(spark, d, 1, 8)
    t = (F.col("label") % 8).cast("int")
    return e.select("vec_id", F.round(L.softmax_output(F.col("x"), t), 6).alias("ll"), (F.get("x", t) == F.array_max("x")).cast("int").alias("hit"))


@query("layer_layernorm", f"WITH {A8}, m AS (SELECT vec_id, avg(x) AS m, var_pop(x) AS v FROM e GROUP BY vec_id) SELECT vec_id, i, round((x - m) / sqrt(v + 1e-4), 6) + 0.0::DOUBLE AS y, round((x - m) / sqrt(v + 1e-4) * (i / 4.0) + 0.5, 6) + 0.0::DOUBLE AS s FROM e JOIN m USING (vec_id)")
def layer_layernorm(spark, d):
    e = dense(spark, d, 1, 8).withColumn("y", L.layer_norm(F.col("x"), 8))
    return spread(e.withColumn("s", L.scale(F.col("y"), [i / 4 for i in range(1, 9)], [0.5] * 8)), "y", "s", digits=6)


@query("layer_batchnorm", f"WITH {A8}, m AS (SELECT i, avg(x) AS m, var_pop(x) AS v FROM e GROUP BY i) SELECT vec_id, i, round((x - m) / sqrt(v + 1e-4), 6) + 0.0::DOUBLE AS x, round((x - m) / sqrt(v + 1e-4) * 2 - 1, 6) + 0.0::DOUBLE AS s FROM e JOIN m USING (i)")
def layer_batchnorm(spark, d):
    e = L.batch_norm(dense(spark, d, 1, 8).select("vec_id", "x"), "x", 8)
    return spread(e.withColumn("s", L.scale(F.col("x"), [2.0] * 8, [-1.0] * 8)), "x", "s", digits=6)


@query("layer_autonorm", f"WITH {A8}, m AS (SELECT i, 0.001 * avg(x) AS m, 0.001 * avg(x * x) + 0.999 AS q FROM e GROUP BY i) SELECT vec_id, i, round((x - m) / sqrt(q - m * m + 1e-4), 6) + 0.0::DOUBLE AS y FROM e JOIN m USING (i)")
def layer_autonorm(spark, d):
    """By moving moments that start at 0 and 1 and have seen one batch."""
    e = dense(spark, d, 1, 8)
    at = [F.get("x", F.lit(i)) for i in range(8)]
    m = e.agg(F.array(*[0.001 * F.avg(a) for a in at]).alias("m"), F.array(*[0.001 * F.avg(a * a) + 0.999 for a in at]).alias("q"))
    j = e.crossJoin(F.broadcast(m)).withColumn("z", F.arrays_zip("x", "m", "q"))
    return spread(j.select("vec_id", F.transform("z", lambda z: (z["x"] - z["m"]) / F.sqrt(z["q"] - z["m"] * z["m"] + 1e-4)).alias("y")), "y", digits=6)


@query("layer_lrn_across", f"WITH {A8} SELECT p.vec_id, p.i, round(max(p.x) / pow(2 + sum(q.x * q.x) / 5, 0.5), 7) + 0.0::DOUBLE AS y FROM e p JOIN e q ON p.vec_id = q.vec_id AND q.i BETWEEN p.i - 2 AND p.i + 2 GROUP BY p.vec_id, p.i")
def layer_lrn_across(spark, d):
    return spread(dense(spark, d, 1, 8).select("vec_id", L.lrn_across(F.col("x"), 8).alias("y")), "y")


@query("layer_lrn_within", f"WITH {LONG}, p AS (SELECT vec_id, i, (i - 1) // 4 AS r, (i - 1) % 4 AS c, x FROM lng WHERE i <= 16) SELECT p.vec_id, p.i, round(max(p.x) / pow(1 + sum(q.x * q.x) / 9, 0.75), 7) + 0.0::DOUBLE AS y FROM p JOIN p q ON p.vec_id = q.vec_id AND abs(q.r - p.r) <= 1 AND abs(q.c - p.c) <= 1 GROUP BY p.vec_id, p.i")
def layer_lrn_within(spark, d):
    """Over windows of three by three cells of a four by four image."""
    return spread(dense(spark, d, 1, 16).select("vec_id", L.lrn_within(F.col("x"), 4, 4).alias("y")), "y")


@query("layer_reduce", f"WITH {TWO}, t AS (SELECT *, max(a) OVER (PARTITION BY vec_id) AS m, min(a) OVER (PARTITION BY vec_id) AS n FROM two) SELECT vec_id, round(sum(a * b), 6) AS dot, round(sum(a), 6) AS sum, max(a) AS maxi, min(a) AS mini, min(i) FILTER (WHERE a = m) AS max_at, min(i) FILTER (WHERE a = n) AS min_at FROM t GROUP BY vec_id")
def layer_reduce(spark, d):
    a, b = F.col("a"), F.col("b")
    return two(spark, d).select("vec_id", F.round(A.dot(a, b), 6).alias("dot"), F.round(A.total(a), 6).alias("sum"), F.array_max(a).alias("maxi"), F.array_min(a).alias("mini"), (A.argmax(a) + 1).alias("max_at"), (A.argmin(a) + 1).alias("min_at"))


@query("layer_onehot", "SELECT vec_id, CAST(g.i AS INTEGER) AS i, CASE WHEN label = g.i - 1 THEN 1.0 ELSE 0.0 END AS y FROM embeddings, range(1, 11) g(i)")
def layer_onehot(spark, d):
    return spread(table(spark, d, "embeddings").select("vec_id", L.one_hot(F.col("label"), 10).alias("y")), "y")


@query("layer_select", "SELECT vec_id, CAST(embedding[label + 1] AS DOUBLE) AS y FROM embeddings")
def layer_select(spark, d):
    return dense(spark, d, 1, 64).select("vec_id", F.get("x", F.col("label")).alias("y"))


@query("layer_linear", f"WITH {A8} SELECT vec_id, r AS i, round(sum(x * ((i * r) % 5 - 2) / 10.0::DOUBLE) + r / 10.0::DOUBLE, 6) + 0.0::DOUBLE AS y FROM e, (VALUES (1), (2), (3)) g(r) GROUP BY vec_id, r")
def layer_linear(spark, d):
    w = [[((i * r) % 5 - 2) / 10 for i in range(1, 9)] for r in (1, 2, 3)]
    return spread(dense(spark, d, 1, 8).select("vec_id", L.dense_net(F.col("x"), [w], [[0.1, 0.2, 0.3]]).alias("y")), "y", digits=6)


@query("net_dense", f"WITH {A8}, h AS (SELECT vec_id, r, tanh(sum(x * ((i * r) % 5 - 2) / 10.0::DOUBLE) + r / 10.0::DOUBLE) AS h FROM e, (VALUES (1), (2), (3)) g(r) GROUP BY vec_id, r) SELECT vec_id, 1 AS i, round(sum(h * r / 4.0::DOUBLE) - 0.2, 6) + 0.0::DOUBLE AS y FROM h GROUP BY vec_id")
def net_dense(spark, d):
    w = [[((i * r) % 5 - 2) / 10 for i in range(1, 9)] for r in (1, 2, 3)]
    return spread(dense(spark, d, 1, 8).select("vec_id", L.dense_net(F.col("x"), [w, [[0.25, 0.5, 0.75]]], [[0.1, 0.2, 0.3], [-0.2]]).alias("y")), "y", digits=6)


@query("net_fit", None)
def net_fit(spark, d):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    data = dense(spark, d, 1, 64).select("vec_id", array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"))
    return MultilayerPerceptronClassifier(layers=[64, 8, 10], maxIter=5, seed=1).fit(data).transform(data).select("vec_id", "prediction")


@query("layer_matmul", "SELECT vec_id, CAST(r * 2 + c + 1 AS INTEGER) AS i, round(CAST(embedding[r * 2 + 1] AS DOUBLE) * CAST(embedding[9 + c] AS DOUBLE) + CAST(embedding[r * 2 + 2] AS DOUBLE) * CAST(embedding[11 + c] AS DOUBLE), 7) + 0.0::DOUBLE AS y FROM embeddings, range(0, 2) a(r), range(0, 2) b(c)")
def layer_matmul(spark, d):
    e = dense(spark, d, 1, 16)
    return spread(e.select("vec_id", L.matmul(F.slice("x", 1, 4), F.slice("x", 9, 4), 2, 2, 2).alias("y")), "y")


@query("layer_transpose", f"WITH {A8} SELECT vec_id, ((i - 1) % 4) * 2 + (i - 1) // 4 + 1 AS i, round(x, 7) + 0.0::DOUBLE AS y FROM e")
def layer_transpose(spark, d):
    return spread(dense(spark, d, 1, 8).select("vec_id", L.transpose(F.col("x"), 2, 4).alias("y")), "y")


@query("layer_format", f"WITH {A8} SELECT vec_id, ((i - 1) % 4) * 2 + (i - 1) // 4 + 1 AS i, round(x, 7) + 0.0::DOUBLE AS y FROM e")
def layer_format(spark, d):
    return spread(dense(spark, d, 1, 8).select("vec_id", L.reformat(F.col("x"), 2, 2, 2).alias("y")), "y")


@query("layer_reshape", f"WITH {A8} SELECT vec_id, CAST((i - 1) // 4 AS INTEGER) AS r, CAST((i - 1) % 4 AS INTEGER) AS c, x AS y FROM e")
def layer_reshape(spark, d):
    z = dense(spark, d, 1, 8).select("vec_id", F.posexplode("x").alias("i", "y"))
    return z.select("vec_id", F.floor(F.col("i") / 4).cast("int").alias("r"), (F.col("i") % 4).cast("int").alias("c"), "y")


@query("layer_slices", f"WITH {A8} SELECT vec_id, CASE WHEN i <= 4 THEN 'top' ELSE 'bottom' END AS part, round(sum(x), 6) AS s FROM e WHERE vec_id BETWEEN 10 AND 99 GROUP BY ALL")
def layer_slices(spark, d):
    """Column slices, and a vertical split."""
    e = dense(spark, d, 1, 8).where("vec_id between 10 and 99")
    top, bottom = L.split_vertical(F.col("x"), 8, 2)
    return e.select("vec_id", F.explode(F.array(F.struct(F.lit("top").alias("part"), A.total(top).alias("s")), F.struct(F.lit("bottom").alias("part"), A.total(bottom).alias("s")))).alias("z")).select("vec_id", "z.part", F.round("z.s", 6).alias("s"))


RANKED = "rnk AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r, count(*) OVER () AS n FROM embeddings)"


def ranked(spark, d, n=8):
    """(vec_id, x, r): rows by their place in the table, which is what a matrix's columns are."""
    from tallyforge.operators.ordering import row_numbers

    return row_numbers(dense(spark, d, 1, n).select("vec_id", "x"), ("vec_id",), "r")


@query("layer_split_horiz", f"WITH {LONG}, {RANKED} SELECT r // 125 AS part, r % 125 AS place, i, round(x, 7) + 0.0::DOUBLE AS x FROM lng JOIN rnk USING (vec_id) WHERE i <= 8")
def layer_split_horiz(spark, d):
    """A block's columns in parts of 125, each numbered anew."""
    e = ranked(spark, d).select(F.floor(F.col("r") / 125).alias("part"), (F.col("r") % 125).alias("place"), F.posexplode("x").alias("i", "x"))
    return e.select("part", "place", (F.col("i") + 1).alias("i"), (F.round("x", 7) + 0.0).alias("x"))


@query("layer_stack", f"WITH {TWO} SELECT vec_id, i, round(a, 7) + 0.0::DOUBLE AS y FROM two UNION ALL SELECT vec_id, i + 8, round(b, 7) + 0.0::DOUBLE FROM two")
def layer_stack(spark, d):
    return spread(two(spark, d).select("vec_id", F.concat("a", "b").alias("y")), "y")


@query("layer_hcat", f"WITH {LONG}, {RANKED} SELECT CASE WHEN r < 250 THEN n - 250 + r ELSE r - 250 END AS place, i, round(x, 7) + 0.0::DOUBLE AS x FROM lng JOIN rnk USING (vec_id) WHERE i <= 8")
def layer_hcat(spark, d):
    """Two blocks side by side: the columns from the 250th on, then the first 250."""
    e = ranked(spark, d)
    first, second = e.where("r >= 250").withColumn("place", F.col("r") - 250), e.where("r < 250")
    size = first.agg(F.count("*").alias("n"))
    both = first.unionByName(second.crossJoin(F.broadcast(size)).withColumn("place", F.col("n") + F.col("r")).drop("n"))
    return both.select("place", F.posexplode("x").alias("i", "x")).select("place", (F.col("i") + 1).alias("i"), (F.round("x", 7) + 0.0).alias("x"))


@query("layer_colperm", f"WITH {RANKED} SELECT (r * 7) % n AS place, vec_id FROM rnk")
def layer_colperm(spark, d):
    """All columns by an index: seven times their place, around the end (the table's size is no multiple of seven)."""
    e = ranked(spark, d, 1)
    n = e.agg(F.count("*").alias("n"))
    return e.crossJoin(F.broadcast(n)).select(((F.col("r") * 7) % F.col("n")).alias("place"), "vec_id")


@query("layer_crop", f"WITH {LONG} SELECT vec_id, i - 2 AS i, round(x, 7) + 0.0::DOUBLE AS y, round(m, 7) + 0.0::DOUBLE AS m FROM (SELECT p.vec_id, p.i, p.x, CASE WHEN p.vec_id % 2 = 0 THEN q.x ELSE p.x END AS m FROM lng p JOIN lng q ON q.vec_id = p.vec_id AND q.i = 9 - p.i) WHERE i BETWEEN 3 AND 6")
def layer_crop(spark, d):
    """The middle four, and the same mirrored in every second row."""
    e = dense(spark, d, 1, 8).withColumn("y", L.crop(F.col("x"), 2, 4))
    return spread(e.withColumn("m", L.mirror(F.col("y"), F.col("vec_id") % 2 == 0)), "y", "m")


@query("layer_dropout", f"WITH {A8} SELECT vec_id, i, round(x * 0.5, 7) + 0.0::DOUBLE AS y, round(CASE WHEN (((vec_id * 31 + i - 1) * 1103515245 + 12345) % 2147483648) % 1000 < 500 THEN x ELSE 0 END, 7) + 0.0::DOUBLE AS m FROM e")
def layer_dropout(spark, d):
    e = dense(spark, d, 1, 8)
    return spread(e.withColumn("y", L.dropout_predict(F.col("x"), 0.5)).withColumn("m", L.dropout_mask(F.col("x"), F.col("vec_id"), 0.5)), "y", "m")


@query("layer_functions", f"WITH {TWO} SELECT vec_id, i, round(a * a * a, 7) + 0.0::DOUBLE AS y, round(a * b + a, 7) + 0.0::DOUBLE AS z FROM two")
def layer_functions(spark, d):
    """User functions of one element and of two."""
    e = two(spark, d).withColumn("y", L.apply_function(F.col("a"), lambda v: v * v * v))
    return spread(e.withColumn("z", L.apply_function2(F.col("a"), F.col("b"), lambda v, w: v * w + v)), "y", "z")


@query("layer_block_function", f"WITH {A8} SELECT vec_id, round(max(x) - min(x), 6) AS span FROM e GROUP BY vec_id")
def layer_block_function(spark, d):
    """A user function of whole blocks, over Arrow batches."""
    import numpy as np

    def run(parts):
        for pdf in parts:
            x = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, 8))
            yield pdf[["vec_id"]].assign(span=np.round(x.max(axis=1) - x.min(axis=1), 6) if len(pdf) else [])

    return dense(spark, d, 1, 8).select("vec_id", "x").mapInPandas(run, "vec_id long, span double")


@query("layer_conv", f"WITH {LONG}, p AS (SELECT vec_id, (i - 1) // 4 AS r, (i - 1) % 4 AS c, x FROM lng WHERE i <= 16) SELECT a.vec_id, CAST(a.r * 3 + a.c + 1 AS INTEGER) AS i, round(max(a.x) * 1 + sum(CASE WHEN b.r = a.r AND b.c = a.c + 1 THEN b.x * 2 WHEN b.r = a.r + 1 AND b.c = a.c THEN -b.x WHEN b.r = a.r + 1 AND b.c = a.c + 1 THEN b.x * 0.5 ELSE 0 END) + 0.1, 6) + 0.0::DOUBLE AS y FROM p a JOIN p b USING (vec_id) WHERE a.r < 3 AND a.c < 3 GROUP BY a.vec_id, a.r, a.c")
def layer_conv(spark, d):
    e = dense(spark, d, 1, 16)
    return spread(e.select("vec_id", L.conv2d(F.col("x"), 4, 4, [[1.0, 2.0], [-1.0, 0.5]], bias=0.1).alias("y")), "y", digits=6)


@query("layer_pool", f"WITH {LONG}, p AS (SELECT vec_id, (i - 1) // 4 // 2 AS r, (i - 1) % 4 // 2 AS c, x FROM lng WHERE i <= 16) SELECT vec_id, CAST(r * 2 + c + 1 AS INTEGER) AS i, round(max(x), 7) + 0.0::DOUBLE AS y, round(avg(x), 7) + 0.0::DOUBLE AS m FROM p GROUP BY vec_id, r, c")
def layer_pool(spark, d):
    e = dense(spark, d, 1, 16)
    return spread(e.withColumn("y", L.pool(F.col("x"), 4, 4, 2, 2)).withColumn("m", L.pool(F.col("x"), 4, 4, 2, 2, "avg")), "y", "m")


@query("layer_lstm", f"""WITH g AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS c, CAST(embedding[2] AS DOUBLE) AS i, CAST(embedding[3] AS DOUBLE) AS f, CAST(embedding[4] AS DOUBLE) AS o, CAST(embedding[5] AS DOUBLE) AS g FROM embeddings),
n AS (SELECT *, c / (1 + exp(-f)) + tanh(g) / (1 + exp(-i)) AS c2 FROM g) SELECT vec_id, round(c2, 7) AS c, round(tanh(c2) / (1 + exp(-o)), 7) AS h FROM n""")
def layer_lstm(spark, d):
    at = lambda i: F.get("x", F.lit(i))
    c, h = L.lstm_gates(at(0), at(1), at(2), at(3), at(4))
    return dense(spark, d, 1, 5).select("vec_id", F.round(c, 7).alias("c"), F.round(h, 7).alias("h"))


@query("layer_elastic", f"WITH {A8}, m AS (SELECT i, avg(x) AS m FROM e GROUP BY i) SELECT vec_id, i, round(0.9 * x + 0.1 * m, 7) + 0.0::DOUBLE AS y FROM e JOIN m USING (i)")
def layer_elastic(spark, d):
    e = dense(spark, d, 1, 8)
    m = e.agg(F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(8)]).alias("m"))
    return spread(e.crossJoin(F.broadcast(m)).select("vec_id", F.zip_with("x", "m", lambda x, v: L.elastic(x, v, 0.1)).alias("y")), "y")


@query("layer_negsamp", f"WITH {A8} SELECT vec_id, round(sum(CASE WHEN i = 1 THEN ln(1 / (1 + exp(-x))) ELSE ln(1 / (1 + exp(x))) END), 6) AS ll FROM e GROUP BY vec_id")
def layer_negsamp(spark, d):
    return dense(spark, d, 1, 8).select("vec_id", F.round(L.negative_sampling(F.get("x", F.lit(0)), F.slice("x", 2, 7)), 6).alias("ll"))


@query("layer_norm_penalty", f"WITH {TWO} SELECT vec_id, i, round(a, 7) + 0.0::DOUBLE AS y, round(-0.01 * a, 7) + 0.0::DOUBLE AS dx FROM two")
def layer_norm_penalty(spark, d):
    """The value as it is; its derivative is the penalty's."""
    return spread(two(spark, d).withColumn("y", F.col("a")).withColumn("dx", F.transform("a", lambda v: -0.01 * v)), "y", "dx")


@query("layer_constant", "SELECT vec_id, 1.5::DOUBLE AS y FROM embeddings")
def layer_constant(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.lit(1.5).alias("y"))


@query("layer_glm", f"WITH {A8} SELECT vec_id, i, round(1 / (1 + exp(-x)), 7) AS y, round((label % 2) - 1 / (1 + exp(-x)), 7) + 0.0::DOUBLE AS dx FROM e")
def layer_glm(spark, d):
    from tallyforge.operators.regression import LINKS

    link, t = LINKS["logistic"], F.col("label") % 2
    e = dense(spark, d, 1, 8).withColumn("y", F.transform("x", link.mean))
    return spread(e.withColumn("dx", F.transform("y", lambda p: link.slope(p, t))), "y", "dx")
