"""Training over the tables: sparse linear models with several targets, factorisation machines, networks and the
backward passes of their layers, k-means passes, topic and word models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import arrays as A
from tallyforge.functions.special import logistic
from tallyforge.operators import cluster as C
from tallyforge.operators import layers as L
from tallyforge.operators import network as N
from tallyforge.operators import regression as G
from tallyforge.operators.linear import pair_cross
from tallyforge.plans.catalog import query
from tallyforge.plans.fixtures import LONG, RATINGS, SAMPLES, TOKENS, dense, ratings, samples, table
from tallyforge.plans.layer_plans import TWO, spread, two
from tallyforge.plans.linear_plans import _uni
from tallyforge.plans.model_plans import ETA, FEATURES, NEAR, V1, V2, WEIGHTS

# Sparse linear models ----------------------------------------------------------------------------------------------

SEGMENTS = ["BUILDING", "MACHINERY", "AUTOMOBILE"]


def order_parts(spark, d):
    """Samples (sample, key, x): how often a customer bought from a supplier; targets (sample, target, t): one against
    all for three market segments; a model of zeros."""
    li, o, c = (table(spark, d, n) for n in ("lineitem", "orders", "customer"))
    t = li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy(F.col("o_custkey").alias("sample"), F.col("l_suppkey").alias("key")).agg(F.count("*").cast("double").alias("x"))
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("target"), (F.col("c_mktsegment") == s).cast("double").alias("t")) for i, s in enumerate(SEGMENTS)])).alias("y")
    y = c.select(F.col("c_custkey").alias("sample"), one).select("sample", "y.*")
    m = table(spark, d, "supplier").select(F.explode(F.sequence(F.lit(0), F.lit(len(SEGMENTS) - 1))).alias("target"), F.col("s_suppkey").alias("key"), F.lit(0.0).alias("w"), F.lit(0.0).alias("ss"))
    return t, y, m


def _sparse_sql(batches: int = 4, rate: float = 0.1, l1: float = 0.01) -> str:
    """Steps over batches 1 to 3 of the customers by their key modulo 4; batch 0 is held out."""
    cte = f"""WITH t AS (SELECT o_custkey AS sample, l_suppkey AS key, CAST(count(*) AS DOUBLE) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
g3 AS (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS target, unnest({SEGMENTS}) AS seg), y AS (SELECT c_custkey AS sample, target, CASE WHEN c_mktsegment = seg THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t FROM customer, g3),
m0 AS (SELECT target, s_suppkey AS key, 0.0::DOUBLE AS w, 0.0::DOUBLE AS ss FROM supplier, g3)"""
    for s in range(1, batches):
        a = 1.0 / (s + 1)
        cte += f""", e{s} AS (SELECT sample, target, sum(w * x) AS eta FROM t JOIN m{s - 1} USING (key) WHERE sample % {batches} = {s} GROUP BY ALL),
d{s} AS (SELECT sample, target, t - 1 / (1 + exp(-coalesce(eta, 0))) AS d FROM y LEFT JOIN e{s} USING (sample, target) WHERE sample % {batches} = {s}),
s{s} AS (SELECT target, key, sum(d * x) AS g FROM t JOIN d{s} USING (sample) GROUP BY ALL),
p{s} AS (SELECT m.target, m.key, w, ss, coalesce(g, 0) - {l1} * sign(w) AS g FROM m{s - 1} m LEFT JOIN s{s} USING (target, key)),
m{s} AS (SELECT target, key, w + {rate} * g / sqrt((1 - {a}::DOUBLE) * ss + {a}::DOUBLE * g * g + 1e-5::DOUBLE) AS w, (1 - {a}::DOUBLE) * ss + {a}::DOUBLE * g * g AS ss FROM p{s})"""
    return cte


def _sparse(spark, d):
    t, y, m = order_parts(spark, d)
    return G.train_minibatches(t, y, m, "logistic", F.pmod(F.col("sample"), F.lit(4)), 4, 0.1, l1=0.01, held=0)


@query("glm_sparse_train", _sparse_sql() + " SELECT target, key, round(w, 5) + 0.0::DOUBLE AS w, round(ss, 4) AS ss FROM m3")
def glm_sparse_train(spark, d):
    """Three targets, minibatches, ADAGrad and an L1 penalty over a sparse model."""
    model, _ = _sparse(spark, d)
    return model.select("target", "key", (F.round("w", 5) + 0.0).alias("w"), F.round("ss", 4).alias("ss"))


@query("glm_sparse_heldout", _sparse_sql() + ", e AS (SELECT sample, target, sum(w * x) AS eta FROM t JOIN m3 USING (key) WHERE sample % 4 = 0 GROUP BY ALL), q AS (SELECT target, t, 1 / (1 + exp(-coalesce(eta, 0))) AS p FROM y LEFT JOIN e USING (sample, target) WHERE sample % 4 = 0) SELECT target, round(avg(ln(t * p + (1 - t) * (1 - p) + 1e-20)), 5) AS ll FROM q GROUP BY target")
def glm_sparse_heldout(spark, d):
    """Its score on the batch that was held out, by target."""
    _, score = _sparse(spark, d)
    return score.select("target", F.round("ll", 5).alias("ll"))


_PAIRS = " + ".join(f"(sqrt({i * 3 + j}) / 10 - 0.25::DOUBLE) * f{i} * f{j}" for i in range(1, 4) for j in range(1, i + 1))


@query("glm_pair", f"WITH {SAMPLES}, e AS (SELECT id, {_PAIRS} AS e FROM smp) SELECT id, round(e, 6) + 0.0::DOUBLE AS eta, round(1 / (1 + exp(-e)), 6) AS pred FROM e")
def glm_pair(spark, d):
    """A linear model over the products of all pairs of features."""
    s = samples(spark, d)
    long = s.select("id", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"f{i}").alias("v")) for i in (1, 2, 3)])).alias("z")).select("id", "z.*")
    w = F.sqrt(F.col("f1") * 3 + F.col("f2")) / 10 - 0.25
    e = pair_cross(long, "id", "f", "v").groupBy("id").agg(F.sum(w * F.col("value")).alias("eta"))
    return e.select("id", (F.round("eta", 6) + 0.0).alias("eta"), F.round(logistic(F.col("eta")), 6).alias("pred"))


_A, _B = ("0.3::DOUBLE * f1 - 0.2::DOUBLE * f2 + 0.5::DOUBLE * f3", "0.1::DOUBLE * f1 + 0.4::DOUBLE * f2 - 0.3::DOUBLE * f3")
_FM = f"WITH {SAMPLES}, s AS (SELECT *, {_A} AS a, {_B} AS b, {ETA} AS e FROM smp), dd AS (SELECT *, y - 1 / (1 + exp(-(e + a * a - b * b))) AS d FROM s) "


@query("fm_grad", _FM + "SELECT " + ", ".join([*[f"round(avg(d * f{i}), 7) AS w{i}" for i in (1, 2, 3)], "round(avg(d), 7) AS w4", *[f"round(avg(2 * d * a * f{i}), 7) AS a{i}" for i in (1, 2, 3)], *[f"round(avg(-2 * d * b * f{i}), 7) AS b{i}" for i in (1, 2, 3)]]) + " FROM dd")
def fm_grad(spark, d):
    """Gradients of a factorisation machine's score by weights and both factor matrices."""
    w, v1, v2 = G.fm_gradient(samples(spark, d), FEATURES, WEIGHTS, V1, V2, "y")
    return spark.createDataFrame([tuple(round(x, 7) for x in (*w, *v1[0], *v2[0]))], ", ".join(f"{n} double" for n in ("w1", "w2", "w3", "w4", "a1", "a2", "a3", "b1", "b2", "b3")))


def _fm_step(n: int) -> str:
    names = ["w1", "w2", "w3", "w4", "a1", "a2", "a3", "b1", "b2", "b3"]
    parts = [f"d * f{i}" for i in (1, 2, 3)] + ["d"] + [f"2 * d * a * f{i}" for i in (1, 2, 3)] + [f"-2 * d * b * f{i}" for i in (1, 2, 3)]
    line = lambda k: " + ".join(f"{k}{i} * f{i}" for i in (1, 2, 3))
    return f"""x{n} AS (SELECT *, y - 1 / (1 + exp(-(e + a * a - b * b))) AS d FROM (SELECT *, {line('w')} + w4 AS e, {line('a')} AS a, {line('b')} AS b FROM smp, m{n - 1})),
m{n} AS (SELECT {', '.join(f'any_value({k}) + 0.5::DOUBLE * avg({p}) AS {k}' for k, p in zip(names, parts))} FROM x{n})"""


_FM0 = ", ".join(f"{v}::DOUBLE AS {k}" for k, v in zip(("w1", "w2", "w3", "w4", "a1", "a2", "a3", "b1", "b2", "b3"), (*WEIGHTS, *V1[0], *V2[0])))


@query("fm_train", f"WITH {SAMPLES}, m0 AS (SELECT {_FM0}), {_fm_step(1)}, {_fm_step(2)} SELECT " + ", ".join(f"round({k}, 6) AS {k}" for k in ("w1", "w2", "w3", "w4", "a1", "a2", "a3", "b1", "b2", "b3")) + " FROM m2")
def fm_train(spark, d):
    s = samples(spark, d).persist()
    w, v1, v2 = G.fm_train(s, FEATURES, WEIGHTS, V1, V2, "y", 2, 0.5)
    s.unpersist()
    return spark.createDataFrame([tuple(round(x, 6) for x in (*w, *v1[0], *v2[0]))], ", ".join(f"{n} double" for n in ("w1", "w2", "w3", "w4", "a1", "a2", "a3", "b1", "b2", "b3")))


# Networks ----------------------------------------------------------------------------------------------------------

#: x -> (linear, tanh) as one compound node h; x -> linear k; (h + k) * v with a trained v; linear to one output.
NET = [
    N.Node("h", "compound", ("x",), inside=[N.Node("lin", "linear", ("in0",), 3, 2), N.Node("act", "tanh", ("lin",))]),
    N.Node("k", "linear", ("x",), 3, 2),
    N.Node("a", "add", ("h", "k")),
    N.Node("v", "variable", (), 0, 2),
    N.Node("m", "mul", ("a", "v")),
    N.Node("o", "linear", ("m",), 2, 1),
]
START = {"h_lin": [0.5, -0.4, 0.3, -0.2, 0.6, 0.1, 0.05, -0.05], "k": [0.1, 0.2, -0.3, 0.4, -0.1, 0.2, 0.0, 0.1], "v": [1.0, -0.5], "o": [0.7, 0.3, -0.1]}
_NAMES = [f"{n}_{i}" for n, ws in START.items() for i in range(len(ws))]


def _net_step(n: int, rate: float = 0.5) -> str:
    """The same step written out: forward, slopes, and mean gradients."""
    lin = lambda w, r: f"{w}_{3 * r} * f1 + {w}_{3 * r + 1} * f2 + {w}_{3 * r + 2} * f3 + {w}_{6 + r}"
    grads = {f"h_lin_{3 * r + i}": f"da{r} * (1 - t{r} * t{r}) * f{i + 1}" for r in range(2) for i in range(3)} | {f"h_lin_{6 + r}": f"da{r} * (1 - t{r} * t{r})" for r in range(2)}
    grads |= {f"k_{3 * r + i}": f"da{r} * f{i + 1}" for r in range(2) for i in range(3)} | {f"k_{6 + r}": f"da{r}" for r in range(2)}
    grads |= {f"v_{r}": f"d * o_{r} * a{r}" for r in range(2)} | {f"o_{r}": f"d * a{r} * v_{r}" for r in range(2)} | {"o_2": "d"}
    return f"""f{n} AS (SELECT *, t0 + {lin('k', 0)} AS a0, t1 + {lin('k', 1)} AS a1 FROM (SELECT *, tanh({lin('h_lin', 0)}) AS t0, tanh({lin('h_lin', 1)}) AS t1 FROM smp, n{n - 1})),
d{n} AS (SELECT *, d * o_0 * v_0 AS da0, d * o_1 * v_1 AS da1 FROM (SELECT *, y - 1 / (1 + exp(-(o_0 * a0 * v_0 + o_1 * a1 * v_1 + o_2))) AS d FROM f{n})),
n{n} AS (SELECT {', '.join(f'any_value({k}) + {rate}::DOUBLE * avg({grads[k]}) AS {k}' for k in _NAMES)} FROM d{n})"""


_NET0 = "n0 AS (SELECT " + ", ".join(f"{v}::DOUBLE AS {n}_{i}" for n, ws in START.items() for i, v in enumerate(ws)) + ")"


@query("net_train", f"WITH {SAMPLES}, {_NET0}, {_net_step(1)}, {_net_step(2)} SELECT k, round(w, 6) AS w FROM (UNPIVOT (SELECT {', '.join(_NAMES)} FROM n2) ON {', '.join(_NAMES)} INTO NAME k VALUE w)")
def net_train(spark, d):
    """Two steps of a graph with a compound node, a sum, a product with a trained constant, and a logistic score."""
    s = samples(spark, d).select(F.array(*FEATURES).alias("x"), "y").persist()
    slope = F.array(F.col("y") - logistic(F.get("o", F.lit(0))))
    w = N.train(s, NET, START, slope, 2, 0.5)
    s.unpersist()
    return spark.createDataFrame([(f"{n}_{i}", round(v, 6)) for n, ws in w.items() for i, v in enumerate(ws)], "k string, w double")


@query("net_forward", f"WITH {SAMPLES}, {_NET0}, {_net_step(1)} SELECT id, round(o_0 * a0 * v_0 + o_1 * a1 * v_1 + o_2, 6) + 0.0::DOUBLE AS y FROM f1")
def net_forward(spark, d):
    s = samples(spark, d).select("id", F.array(*FEATURES).alias("x"))
    return N.forward(s, NET, START).select("id", (F.round(F.get("o", F.lit(0)), 6) + 0.0).alias("y"))


# Backward passes ---------------------------------------------------------------------------------------------------


@query("layer_linear_back", f"WITH {LONG}, x AS (SELECT vec_id, i, x FROM lng WHERE i <= 8), dy AS (SELECT vec_id, i - 8 AS r, x AS dy FROM lng WHERE i BETWEEN 9 AND 11) SELECT vec_id, i, round(sum(dy * ((i * r) % 5 - 2) / 10.0::DOUBLE), 7) + 0.0::DOUBLE AS dx FROM x JOIN dy USING (vec_id) GROUP BY vec_id, i")
def layer_linear_back(spark, d):
    w = [((i * r) % 5 - 2) / 10 for r in (1, 2, 3) for i in range(1, 9)] + [0.0] * 3
    nodes = [N.Node("y", "linear", ("x",), 8, 3)]
    e = two(spark, d).select("vec_id", F.col("a").alias("x"), F.slice("b", 1, 3).alias("dy"))
    return spread(N.backward(N.forward(e, nodes, {"y": w}), nodes, {"y": w}, "dy").select("vec_id", F.col("d_x").alias("dx")), "dx")


@query("layer_linear_grad", f"WITH {LONG}, x AS (SELECT vec_id, i, x FROM lng WHERE i <= 8), dy AS (SELECT vec_id, i - 8 AS r, x AS dy FROM lng WHERE i BETWEEN 9 AND 11) SELECT CAST((r - 1) * 8 + i - 1 AS INTEGER) AS k, round(avg(dy * x), 7) + 0.0::DOUBLE AS g FROM x JOIN dy USING (vec_id) GROUP BY r, i UNION ALL SELECT CAST(23 + r AS INTEGER), round(avg(dy), 7) + 0.0::DOUBLE FROM dy GROUP BY r")
def layer_linear_grad(spark, d):
    w = {"y": [0.0] * 27}
    nodes = [N.Node("y", "linear", ("x",), 8, 3)]
    e = two(spark, d).select(F.col("a").alias("x"), F.slice("b", 1, 3).alias("dy"))
    g = N.gradients(N.backward(N.forward(e, nodes, w), nodes, w, "dy"), nodes)["y"]
    return spark.createDataFrame([(k, round(v, 7) + 0.0) for k, v in enumerate(g)], "k int, g double")


_AT = lambda i: f"CAST(embedding[{i}] AS DOUBLE)"


def _cells(exprs: list[str], name: str, digits: int = 7) -> str:
    return " UNION ALL ".join(f"SELECT vec_id, {i + 1} AS i, round({e}, {digits}) + 0.0::DOUBLE AS {name} FROM embeddings" for i, e in enumerate(exprs))


_DA = [f"{_AT(9 + 2 * r)} * {_AT(5 + 2 * k)} + {_AT(10 + 2 * r)} * {_AT(6 + 2 * k)}" for r in range(2) for k in range(2)]
_DB = [f"{_AT(1 + k)} * {_AT(9 + c)} + {_AT(3 + k)} * {_AT(11 + c)}" for k in range(2) for c in range(2)]


@query("layer_matmul_back", f"WITH a AS ({_cells(_DA, 'da')}), b AS ({_cells(_DB, 'db')}) SELECT vec_id, i, da, db FROM a JOIN b USING (vec_id, i)")
def layer_matmul_back(spark, d):
    """Slopes by both factors of a 2 by 2 product: coordinates 1 to 4, 5 to 8; dy is 9 to 12."""
    e = dense(spark, d, 1, 12)
    da, db = N.matmul_backward(F.slice("x", 1, 4), F.slice("x", 5, 4), F.slice("x", 9, 4), 2, 2, 2)
    return spread(e.select("vec_id", da.alias("da"), db.alias("db")), "da", "db")


@query("layer_layernorm_back", f"WITH {TWO}, m AS (SELECT vec_id, avg(a) AS m, sqrt(var_pop(a) + 1e-4) AS s FROM two GROUP BY vec_id), y AS (SELECT vec_id, i, (a - m) / s AS y, b AS dy, s FROM two JOIN m USING (vec_id)), q AS (SELECT vec_id, avg(dy) AS d, avg(dy * y) AS e FROM y GROUP BY vec_id) SELECT vec_id, i, round((dy - d - y * e) / s, 6) + 0.0::DOUBLE AS dx FROM y JOIN q USING (vec_id)")
def layer_layernorm_back(spark, d):
    e = two(spark, d).withColumn("y", L.layer_norm(F.col("a"), 8))
    mean = A.total(F.col("a")) / 8
    deviation = F.sqrt(F.aggregate("a", F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / 8 + 1e-4)
    return spread(e.select("vec_id", N.layer_norm_backward(F.col("y"), deviation, F.col("b"), 8).alias("dx")), "dx", digits=6)


_KERNEL = [[1.0, 2.0], [-1.0, 0.5]]
_CONV = [" + ".join(f"{_AT((r - i) * 3 + c - j + 1)} * {_KERNEL[i][j]}::DOUBLE" for i in range(2) for j in range(2) if 0 <= r - i < 3 and 0 <= c - j < 3) for r in range(4) for c in range(4)]


@query("layer_conv_back", _cells(_CONV, "dx", 6))
def layer_conv_back(spark, d):
    """dx of a 4 by 4 image under a 2 by 2 kernel; dy is coordinates 1 to 9."""
    return spread(dense(spark, d, 1, 9).select("vec_id", N.conv2d_backward(F.col("x"), 4, 4, _KERNEL).alias("dx")), "dx", digits=6)


@query("layer_pool_back", f"WITH {LONG}, p AS (SELECT vec_id, i, (i - 1) // 4 // 2 * 2 + (i - 1) % 4 // 2 AS w, x FROM lng WHERE i <= 16), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, w ORDER BY x DESC, i) AS k FROM p) SELECT k.vec_id, k.i, round(CASE WHEN k.k = 1 THEN g.x ELSE 0.0 END, 7) + 0.0::DOUBLE AS dx FROM k JOIN lng g ON g.vec_id = k.vec_id AND g.i = 17 + k.w")
def layer_pool_back(spark, d):
    """Largest of 2 by 2 windows: coordinates 1 to 16; dy is 17 to 20."""
    e = dense(spark, d, 1, 20)
    return spread(e.select("vec_id", N.max_pool_backward(F.slice("x", 1, 16), F.slice("x", 17, 4), 4, 4, 2).alias("dx")), "dx")


_S = lambda x: f"(1 / (1 + exp(-({x}))))"


@query("layer_lstm_back", f"""WITH g AS (SELECT vec_id, {_AT(1)} AS c, {_AT(2)} AS i, {_AT(3)} AS f, {_AT(4)} AS o, {_AT(5)} AS g, {_AT(6)} AS dc, {_AT(7)} AS dh FROM embeddings),
n AS (SELECT *, c * {_S('f')} + tanh(g) * {_S('i')} AS n FROM g), k AS (SELECT *, dc + dh * {_S('o')} * (1 - tanh(n) * tanh(n)) AS k FROM n)
SELECT vec_id, round(k * {_S('f')}, 6) + 0.0::DOUBLE AS c, round(k * tanh(g) * {_S('i')} * (1 - {_S('i')}), 6) + 0.0::DOUBLE AS i, round(k * c * {_S('f')} * (1 - {_S('f')}), 6) + 0.0::DOUBLE AS f, round(dh * tanh(n) * {_S('o')} * (1 - {_S('o')}), 6) + 0.0::DOUBLE AS o, round(k * {_S('i')} * (1 - tanh(g) * tanh(g)), 6) + 0.0::DOUBLE AS g FROM k""")
def layer_lstm_back(spark, d):
    at = lambda i: F.get("x", F.lit(i))
    gates = [at(i) for i in range(5)]
    new, _ = L.lstm_gates(*gates)
    s = N.lstm_backward(*gates, new, at(5), at(6))
    return dense(spark, d, 1, 7).select("vec_id", *[(F.round(c, 6) + 0.0).alias(n) for n, c in s.items()])


# Passes and fits ---------------------------------------------------------------------------------------------------


def _pass_sql(n: int, src: str) -> str:
    return f"""d{n} AS (SELECT vec_id, cid, sum((x - c) * (x - c)) AS d2 FROM lng JOIN {src} USING (i) GROUP BY ALL), a{n} AS (SELECT vec_id, cid FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d2, 9), cid) AS k FROM d{n}) WHERE k = 1),
c{n} AS (SELECT cid, i, avg(x) AS c FROM a{n} JOIN lng USING (vec_id) GROUP BY ALL)"""


@query("kmeans_passes", f"WITH {LONG}, c0 AS (SELECT vec_id AS cid, i, x AS c FROM lng WHERE vec_id < 4), {_pass_sql(1, 'c0')}, {_pass_sql(2, 'c1')}, {_pass_sql(3, 'c2')} SELECT CAST(cid AS INTEGER) AS cid, count(*) AS n FROM a3 GROUP BY cid")
def kmeans_passes(spark, d):
    """Two passes from the first four rows, then the clusters' sizes."""
    e = dense(spark, d, 1, 64).persist()
    centroids = C.kmeans(e, "vec_id", "x", 4, 3)
    e.unpersist()
    return C.assign(e, "x", centroids).groupBy("cid").agg(F.count("*").alias("n"))


_CHAIN = ", ".join(_pass_sql(n, f"c{n - 1}") for n in range(1, 6))


@query("kmeans_fit", f"WITH {LONG}, c0 AS (SELECT vec_id AS cid, i, x AS c FROM lng WHERE vec_id < 8), {_CHAIN} SELECT CAST(cid AS INTEGER) AS cid, count(*) AS n, round(avg(d2), 4) AS avg_d2 FROM a5 JOIN d5 USING (vec_id, cid) GROUP BY cid")
def kmeans_fit(spark, d):
    """Five passes of eight clusters, by blocks."""
    e = dense(spark, d, 1, 64).persist()
    centroids = C.kmeans(e, "vec_id", "x", 8, 5)
    e.unpersist()
    return C.assign(e, "x", centroids).groupBy("cid").agg(F.count("*").alias("n"), F.round(F.avg("d2"), 4).alias("avg_d2"))


@query("kmeans_init_random", f"SELECT vec_id FROM embeddings ORDER BY {_uni('vec_id', '3')}, vec_id LIMIT 4")
def kmeans_init_random(spark, d):
    """Four rows drawn as first centroids, by a fixed pseudo-random number of their key."""
    from tallyforge.functions import sampling

    return table(spark, d, "embeddings").orderBy(sampling.uniform(F.col("vec_id"), 3), "vec_id").limit(4).select("vec_id")


@query("kmeansw_update", f"WITH {NEAR}, w AS (SELECT vec_id, label + 1 AS w FROM embeddings) SELECT CAST(cid AS INTEGER) AS cid, i, round(sum(x * w) / sum(w), 6) AS m, CAST(sum(w) AS DOUBLE) AS size FROM nea JOIN lng USING (vec_id) JOIN w USING (vec_id) GROUP BY ALL")
def kmeansw_update(spark, d):
    """Centroids and sizes by weighted samples."""
    e = dense(spark, d, 1, 64).withColumn("w", (F.col("label") + 1).cast("double"))
    u = C.update(C.assign(e, "x", C.first_centroids(e, "vec_id", "x", 4)), "x", "w")
    return u.select("cid", F.posexplode("c").alias("i", "m"), F.col("n").alias("size")).select("cid", (F.col("i") + 1).alias("i"), F.round("m", 6).alias("m"), "size")


@query("sfa_users", f"""WITH {RATINGS}, j AS (SELECT "user", rating, (1 + item % 3) / 5.0::DOUBLE AS m1, (1 + item % 5) / 5.0::DOUBLE AS m2 FROM rat),
g AS (SELECT "user", sum(m1 * m1) + 0.5 * count(*) AS a, sum(m1 * m2) AS b, sum(m2 * m2) + 0.5 * count(*) AS c, sum(m1 * rating) AS p, sum(m2 * rating) AS q FROM j GROUP BY 1)
SELECT "user", round((c * p - b * q) / (a * c - b * b), 5) AS u1, round((a * q - b * p) / (a * c - b * b), 5) AS u2 FROM g""")
def sfa_users(spark, d):
    """Users' factors against given item factors, by conjugate gradient; with two factors two steps are exact."""
    from tallyforge.operators.embedding import factor_solve

    r = ratings(spark, d)
    items = r.select("item").distinct().select("item", F.array((1 + F.col("item") % 3) / 5.0, (1 + F.col("item") % 5) / 5.0).alias("m"))
    s = factor_solve(r, items, 2, 0.5)
    return s.select("user", F.round(F.get("u", F.lit(0)), 5).alias("u1"), F.round(F.get("u", F.lit(1)), 5).alias("u2"))


_GRAMS = f"""{TOKENS}, bg AS (SELECT lag(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS centre, tok AS context FROM tok), pos AS (SELECT centre, context, count(*) AS n, 1.0::DOUBLE AS label FROM bg WHERE centre IS NOT NULL GROUP BY ALL),
prs AS (SELECT * FROM pos UNION ALL SELECT context, centre, n, 0.0 FROM pos WHERE centre <> context),
vec AS (SELECT tok, (len(tok) % 5 - 2) / 2.3::DOUBLE AS v1, (ascii(tok) % 7 - 3) / 3.1::DOUBLE AS v2, (len(tok) % 3 - 1) / 1.7::DOUBLE AS c1, (ascii(tok) % 4 - 1) / 2.9::DOUBLE AS c2 FROM (SELECT DISTINCT centre AS tok FROM prs)),
jn AS (SELECT centre, context, n, a.v1, a.v2, b.c1, b.c2, n * (label - 1 / (1 + exp(-(a.v1 * b.c1 + a.v2 * b.c2)))) AS d FROM prs JOIN vec a ON a.tok = centre JOIN vec b ON b.tok = context),
gv AS (SELECT centre AS tok, sum(d * c1) / sum(n) AS g1, sum(d * c2) / sum(n) AS g2 FROM jn GROUP BY 1), gc AS (SELECT context AS tok, sum(d * v1) / sum(n) AS h1, sum(d * v2) / sum(n) AS h2 FROM jn GROUP BY 1)"""


@query("word2vec_step", f"WITH {_GRAMS} SELECT tok, round(v1 + 0.37 * coalesce(g1, 0), 5) + 0.0::DOUBLE AS v1, round(v2 + 0.37 * coalesce(g2, 0), 5) + 0.0::DOUBLE AS v2, round(c1 + 0.37 * coalesce(h1, 0), 5) + 0.0::DOUBLE AS c1, round(c2 + 0.37 * coalesce(h2, 0), 5) + 0.0::DOUBLE AS c2 FROM vec LEFT JOIN gv USING (tok) LEFT JOIN gc USING (tok)")
def word2vec_step(spark, d):
    """One skip-gram step over all neighbouring words (turned round, they serve as the false pairs)."""
    from tallyforge.operators import text
    from tallyforge.operators.embedding import skipgram_step
    from tallyforge.plans.fixtures import token_lists
    from tallyforge.scratch import kept

    grams = kept(text.ngram_counts(token_lists(spark, d), 2), "grams").select(F.col("w1").alias("centre"), F.col("w2").alias("context"), F.col("cnt").alias("n"))
    false = grams.where("centre <> context").select(F.col("context").alias("centre"), F.col("centre").alias("context"), "n", F.lit(0.0).alias("label"))
    pairs = grams.withColumn("label", F.lit(1.0)).unionByName(false)
    tok = grams.select(F.explode(F.array("centre", "context")).alias("tok")).distinct()
    n, a = F.length("tok"), F.ascii("tok")
    words = tok.select(F.col("tok").alias("centre"), F.array((n % 5 - 2) / 2.3, (a % 7 - 3) / 3.1).alias("v"))
    contexts = tok.select(F.col("tok").alias("context"), F.array((n % 3 - 1) / 1.7, (a % 4 - 1) / 2.9).alias("c"))
    v, c = skipgram_step(pairs, words, contexts, 2, 0.37)
    both = v.join(c, v["centre"] == c["context"])
    return both.select(F.col("centre").alias("tok"), *[(F.round(F.get(x, F.lit(i)), 5) + 0.0).alias(f"{x}{i + 1}") for x in "vc" for i in range(2)])


@query("word2vec_tree", f"WITH {TOKENS} SELECT count(*) AS words, 1.0::DOUBLE AS kraft FROM (SELECT tok FROM tok GROUP BY tok HAVING count(*) >= 10)")
def word2vec_tree(spark, d):
    """The Huffman codes are a full prefix code of all known words: the sum of 2 to the minus length is one."""
    from tallyforge.plans.factor_plans import word2vec_hier

    return word2vec_hier(spark, d).agg(F.count("*").alias("words"), F.round(F.sum(F.pow(F.lit(2.0), -F.col("depth"))), 9).alias("kraft"))


def _replica_sql(n: int) -> str:
    return f"r{n} AS (SELECT id % 4 AS rep, any_value(w) + 0.5::DOUBLE * avg((y - 1 / (1 + exp(-w * f1))) * f1) AS w FROM smp, w{n - 1} WHERE id % 3 = {n - 1} GROUP BY 1), w{n} AS (SELECT avg(w) AS w FROM r{n})"


@query("parlearner_rounds", f"WITH {SAMPLES}, w0 AS (SELECT 0.1::DOUBLE AS w), {_replica_sql(1)}, {_replica_sql(2)}, {_replica_sql(3)} SELECT round(w, 6) AS w FROM w3")
def parlearner_rounds(spark, d):
    """Four replicas take a step on a batch of their own samples, then their models are averaged: three rounds."""
    from tallyforge.operators.allreduce import replica_rounds

    slope = lambda w: (F.col("y") - logistic(F.lit(w) * F.col("f1"))) * F.col("f1")
    w = replica_rounds(samples(spark, d), F.col("id") % 4, F.col("id") % 3, 3, 0.1, slope, 0.5)
    return spark.createDataFrame([(round(w, 6),)], "w double")
