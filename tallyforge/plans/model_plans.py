"""Model kernels over the tables: linear models, clusters, forests, treatment effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import cluster as C
from tallyforge.operators import forest as R
from tallyforge.operators import regression as G
from tallyforge.operators import updaters as U
from tallyforge.plans.catalog import query
from tallyforge.plans.fixtures import LONG, SAMPLES, dense, samples, table
from tallyforge.scratch import kept

FEATURES, WEIGHTS = ["f1", "f2", "f3"], [0.8, -1.5, 2.0, 0.1]
ETA = "0.1::DOUBLE + f1 * 0.8::DOUBLE + f2 * -1.5::DOUBLE + f3 * 2.0::DOUBLE"
MEAN = {"linear": "e", "logistic": "1 / (1 + exp(-e))", "maxp": "1 / (1 + exp(-e))", "svm": "e"}
SLOPE = {"linear": "y - p", "logistic": "y - p", "maxp": "(2 * y - 1) * p * (1 - p)", "svm": "CASE WHEN (2 * y - 1) * p < 1 THEN 2 * y - 1 ELSE 0 END"}
SCORE = {"linear": "-(y - p) * (y - p)", "logistic": "ln(y * p + (1 - y) * (1 - p) + 1e-20)", "maxp": "y * p + (1 - y) * (1 - p) - 1", "svm": "least(0, (2 * y - 1) * p - 1)"}

for _link in G.LINKS:
    _pre = f"WITH {SAMPLES}, eta AS (SELECT *, {ETA} AS e FROM smp), prd AS (SELECT *, {MEAN[_link]} AS p FROM eta), dd AS (SELECT *, {SLOPE[_link]} AS d FROM prd)"

    @query(f"glm_fwd_{_link}", f"{_pre} SELECT id, round(e, 7) AS eta, round(p, 7) AS pred, round(d, 7) AS deriv, round({SCORE[_link]}, 6) + 0.0::DOUBLE AS ll FROM dd")
    def _fwd(spark, d, link=_link):
        p = G.forward(samples(spark, d), FEATURES, WEIGHTS, link)
        o = G.LINKS[link]
        return p.select("id", F.round("eta", 7).alias("eta"), F.round("pred", 7).alias("pred"), F.round(o.slope(F.col("pred"), F.col("y")), 7).alias("deriv"), F.round(o.score(F.col("pred"), F.col("y")), 6).alias("ll"))

    @query(f"glm_grad_{_link}", f"{_pre} SELECT round(avg(d * f1), 7) AS g_f1, round(avg(d * f2), 7) AS g_f2, round(avg(d * f3), 7) AS g_f3, round(avg(d), 7) AS g_const, round(avg({SCORE[_link]}), 6) AS ll FROM dd")
    def _grad(spark, d, link=_link):
        g = G.gradient(samples(spark, d), FEATURES, WEIGHTS, link, "y")
        return g.select(*[F.round(c, 6 if c == "ll" else 7).alias(c) for c in g.columns])


_STEP = lambda n, src: f"""s{n} AS (SELECT avg(d * f1) AS g1, avg(d * f2) AS g2, avg(d * f3) AS g3, avg(d) AS g4 FROM (SELECT f1, f2, f3, y - 1 / (1 + exp(-(w4 + f1 * w1 + f2 * w2 + f3 * w3))) AS d FROM smp, {src})),
m{n} AS (SELECT {', '.join(f'(1 - 1.0::DOUBLE / {n}) * q{i} + g{i} * g{i} / {n} AS q{i}, w{i} + 0.5::DOUBLE * g{i} / sqrt((1 - 1.0::DOUBLE / {n}) * q{i} + g{i} * g{i} / {n} + 1e-5::DOUBLE) AS w{i}' for i in range(1, 5))} FROM {src}, s{n})"""  # noqa: E731


@query("glm_train", f"WITH {SAMPLES}, m0 AS (SELECT 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS w3, 0.0::DOUBLE AS w4, 0.0::DOUBLE AS q1, 0.0::DOUBLE AS q2, 0.0::DOUBLE AS q3, 0.0::DOUBLE AS q4), {_STEP(1, 'm0')}, {_STEP(2, 'm1')}, {_STEP(3, 'm2')} SELECT round(w1, 5) AS w1, round(w2, 5) AS w2, round(w3, 5) AS w3, round(w4, 5) AS w4 FROM m3")
def glm_train(spark, d):
    s = samples(spark, d).persist()
    w = G.train(s, FEATURES, "logistic", "y", 3, 0.5)
    s.unpersist()
    return spark.createDataFrame([tuple(round(x, 5) for x in w)], "w1 double, w2 double, w3 double, w4 double")


@query(
    "adagrad_step",
    """WITH t AS (SELECT o_custkey AS sample, l_suppkey AS key, CAST(count(*) AS DOUBLE) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
y AS (SELECT c_custkey AS sample, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0 END AS t FROM customer),
m AS (SELECT s_suppkey AS key, (s_suppkey % 5 - 2) / 10.0::DOUBLE AS w, 0.01::DOUBLE AS ss FROM supplier),
e AS (SELECT sample, sum(w * x) AS eta FROM t JOIN m USING (key) GROUP BY sample),
dd AS (SELECT sample, t - 1 / (1 + exp(-coalesce(eta, 0))) AS d FROM y LEFT JOIN e USING (sample)),
g AS (SELECT key, sum(d * x) AS g FROM t JOIN dd USING (sample) GROUP BY key),
n AS (SELECT key, w, coalesce(g, 0) AS g, ss / 2 + coalesce(g, 0) * coalesce(g, 0) / 2 AS ss FROM m LEFT JOIN g USING (key))
SELECT key, round(w + 0.1::DOUBLE * g / sqrt(ss + 1e-5::DOUBLE), 6) AS w, round(ss, 5) AS ss FROM n""",
)
def adagrad_step(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    t = li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy(F.col("o_custkey").alias("sample"), F.col("l_suppkey").alias("key")).agg(F.count("*").cast("double").alias("x"))
    y = table(spark, d, "customer").select(F.col("c_custkey").alias("sample"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("t"))
    m = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), ((F.col("s_suppkey") % 5 - 2) / 10.0).alias("w"), F.lit(0.01).alias("ss"))
    n = G.adagrad_pass(m, G.sparse_gradient(t, m, y, "logistic"), 1, 0.1)
    return n.select("key", F.round("w", 6).alias("w"), F.round("ss", 5).alias("ss"))


V1, V2 = [[0.3, -0.2, 0.5]], [[0.1, 0.4, -0.3]]


@query("fm", f"WITH {SAMPLES}, s AS (SELECT *, 0.3::DOUBLE * f1 - 0.2::DOUBLE * f2 + 0.5::DOUBLE * f3 AS a, 0.1::DOUBLE * f1 + 0.4::DOUBLE * f2 - 0.3::DOUBLE * f3 AS b, {ETA} AS e FROM smp) SELECT id, round(e + a * a - b * b, 7) AS eta, round(e + a * a - b * b - (0.09::DOUBLE - 0.01::DOUBLE) * f1 * f1 - (0.04::DOUBLE - 0.16::DOUBLE) * f2 * f2 - (0.25::DOUBLE - 0.09::DOUBLE) * f3 * f3, 7) AS strict FROM s")
def fm(spark, d):
    plain, strict = (G.fm_predictor(FEATURES, WEIGHTS, V1, V2, s) for s in (False, True))
    return samples(spark, d).select("id", F.round(plain, 7).alias("eta"), F.round(strict, 7).alias("strict"))


@query("fm_fit", None)
def fm_fit(spark, d):
    """Fit to convergence by the library's factorisation machine."""
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(samples(spark, d).withColumn("label", F.col("y").cast("double")))
    return FMClassifier(factorSize=2, maxIter=3, seed=1).fit(data).transform(data).select("id", "y", "prediction")


@query(
    "iptw",
    f"""WITH {SAMPLES}, s AS (SELECT y, CASE WHEN f2 > 0.05 THEN 1 ELSE 0 END AS t, 1 / (1 + exp(-(f1 - 0.5::DOUBLE + f3 * 4.0::DOUBLE))) AS p, 0.2::DOUBLE + f1 * 0.3::DOUBLE AS m1, 0.1::DOUBLE + f1 * 0.2::DOUBLE AS m0 FROM smp)
SELECT round(avg(t * y / p - (1 - t) * y / (1 - p)), 6) AS ipw, round(avg(t * y / p - (t - p) / p * m1 - ((1 - t) * y / (1 - p) + (t - p) / (1 - p) * m0)), 6) AS aipw FROM s""",
)
def iptw(spark, d):
    from tallyforge.functions.special import logistic

    s = samples(spark, d).select("y", (F.col("f2") > 0.05).cast("int").alias("t"), logistic(F.col("f1") - 0.5 + F.col("f3") * 4.0).alias("p"), (F.lit(0.2) + F.col("f1") * 0.3).alias("m1"), (F.lit(0.1) + F.col("f1") * 0.2).alias("m0"))
    e = G.treatment_effect(s, "t", "y", "p", "m1", "m0")
    return e.select(F.round("ipw", 6).alias("ipw"), F.round("aipw", 6).alias("aipw"))


# Clusters ----------------------------------------------------------------------------------------------------------

NEAR = f"""{LONG}, cen AS (SELECT vec_id AS cid, i, x AS c FROM lng WHERE vec_id < 4),
dst AS (SELECT vec_id, cid, round(sum((x - c) * (x - c)), 9) AS d2 FROM lng JOIN cen USING (i) GROUP BY ALL),
nea AS (SELECT vec_id, cid, d2 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, cid) AS k FROM dst) WHERE k = 1)"""


@query("kmeans_assign", f"WITH {NEAR} SELECT CAST(cid AS INTEGER) AS cluster, count(*) AS n, round(avg(d2), 4) AS avg_d2 FROM nea GROUP BY cid")
def kmeans_assign(spark, d):
    e = dense(spark, d, 1, 64)
    a = C.assign(e, "x", C.first_centroids(e, "vec_id", "x", 4))
    return a.groupBy(F.col("cid").alias("cluster")).agg(F.count("*").alias("n"), F.round(F.avg("d2"), 4).alias("avg_d2"))


@query("kmeans_init", "SELECT CAST(vec_id AS INTEGER) AS cid, round(CAST(embedding[1] AS DOUBLE), 6) AS c1 FROM embeddings WHERE vec_id < 4")
def kmeans_init(spark, d):
    return C.first_centroids(dense(spark, d, 1, 64), "vec_id", "x", 4).select("cid", F.round(F.get("c", F.lit(0)), 6).alias("c1"))


@query("kmeans_update", f"WITH {NEAR} SELECT CAST(cid AS INTEGER) AS cid, i, round(avg(x), 6) AS m FROM nea JOIN lng USING (vec_id) GROUP BY ALL")
def kmeans_update(spark, d):
    e = dense(spark, d, 1, 64)
    u = C.update(C.assign(e, "x", C.first_centroids(e, "vec_id", "x", 4)), "x")
    return u.select("cid", F.posexplode("c").alias("i", "m")).select("cid", (F.col("i") + 1).alias("i"), F.round("m", 6).alias("m"))


@query(
    "kmeans_ties",
    "WITH p AS (SELECT p_partkey AS id, CAST(p_size % 7 AS DOUBLE) AS x FROM part), c(cid, c) AS (VALUES (0, 1.0::DOUBLE), (1, 3.0::DOUBLE), (2, 5.0::DOUBLE)), dd AS (SELECT id, cid, (x - c) * (x - c) AS d2, min((x - c) * (x - c)) OVER (PARTITION BY id) AS m FROM p, c), b AS (SELECT id, cid, 1.0::DOUBLE / count(*) OVER (PARTITION BY id) AS share FROM dd WHERE d2 = m) SELECT cid, round(sum(share), 6) AS n FROM b GROUP BY cid",
)
def kmeans_ties(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array((F.col("p_size") % 7).cast("double")).alias("x"))
    c = spark.createDataFrame([(0, [1.0]), (1, [3.0]), (2, [5.0])], "cid int, c array<double>")
    return C.shares(p, "x", c).groupBy("cid").agg(F.round(F.sum("share"), 6).alias("n"))


@query("kmeansw", f"WITH {NEAR}, w AS (SELECT vec_id, cid, round(d2 + 0.01::DOUBLE * (cid + 1), 9) AS d2 FROM dst), b AS (SELECT vec_id, cid, row_number() OVER (PARTITION BY vec_id ORDER BY d2, cid) AS k FROM w) SELECT CAST(cid AS INTEGER) AS cid, count(*) AS n FROM b WHERE k = 1 GROUP BY cid")
def kmeansw(spark, d):
    e = dense(spark, d, 1, 64)
    cen = C.first_centroids(e, "vec_id", "x", 4).withColumn("size", (F.col("cid") + 1).cast("double"))
    return C.assign(e, "x", cen, penalty=lambda c: 0.01 * c["size"]).groupBy("cid").agg(F.count("*").alias("n"))


@query("kmeans_merge", f"WITH {NEAR}, r AS (SELECT vec_id % 3 AS rep, cid, i, avg(x) AS m, count(*) AS n FROM nea JOIN lng USING (vec_id) GROUP BY ALL) SELECT CAST(cid AS INTEGER) AS cid, i, round(sum(m * n) / sum(n), 6) AS m FROM r GROUP BY cid, i")
def kmeans_merge(spark, d):
    e = dense(spark, d, 1, 64)
    a = C.assign(e, "x", C.first_centroids(e, "vec_id", "x", 4))
    reps = None
    for r in range(3):
        own = C.update(a.where(F.col("vec_id") % 3 == r), "x")
        reps = own if reps is None else reps.unionByName(own)
    return C.merge_models(reps).select("cid", F.posexplode("c").alias("i", "m")).select("cid", (F.col("i") + 1).alias("i"), F.round("m", 6).alias("m"))


@query("pam", None)
def pam(spark, d):
    e = dense(spark, d, 1, 64).persist()
    medoids = spark.createDataFrame(C.pam(e, "vec_id", "x", 4), "cid int, c array<double>")
    e.unpersist()
    got = C.assign(e, "x", medoids)
    return got.groupBy("cid").agg(F.count("*").alias("n"), F.round(F.sum(F.sqrt("d2")), 4).alias("cost"))


@query("pam_cost", f"WITH {NEAR} SELECT round(sum(sqrt(d2)), 3) AS cost FROM nea")
def pam_cost(spark, d):
    e = dense(spark, d, 1, 64)
    return C.medoid_cost(e, "x", C.first_centroids(e, "vec_id", "x", 4)).select(F.round("cost", 3).alias("cost"))


# Forests -----------------------------------------------------------------------------------------------------------

TREE = {"feature": 0, "threshold": 25.0, "low": {"feature": 1, "threshold": 0.05, "low": 0, "high": 1}, "high": {"feature": 2, "threshold": 0.04, "low": 2, "high": 3}}
XS = "[l_quantity, l_discount, l_tax]"


def tree_samples(spark, d):
    """Distinct lines with a number: (sample, xs, label)."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag").agg(F.count("*").alias("n"))
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sample"), F.array("l_quantity", "l_discount", "l_tax").alias("xs"), F.col("l_returnflag").alias("label"))


@query(
    "rf_hist",
    f"""WITH s AS (SELECT l_suppkey % 2 AS tree, l_linenumber AS node, l_returnflag AS label, {XS} AS xs FROM lineitem),
f AS (SELECT *, ((((((((tree * 1103515245 + 12345) % 2147483648) + node) * 1103515245 + 12345) % 2147483648) * 1103515245 + 12345) % 2147483648) // 64) % 3 AS feature FROM s)
SELECT CAST(tree AS INTEGER) AS tree, CAST(node AS BIGINT) AS node, feature, xs[feature + 1] AS value, label, count(*) AS n FROM f GROUP BY ALL""",
)
def rf_hist(spark, d):
    s = table(spark, d, "lineitem").select((F.col("l_suppkey") % 2).cast("int").alias("tree"), F.col("l_linenumber").cast("long").alias("node"), F.array("l_quantity", "l_discount", "l_tax").alias("xs"), F.col("l_returnflag").alias("label"))
    return R.histogram(s, 3, 1, "label")


_IMP = lambda a, n: " ".join(["(", f"{n} * ln({n})", *[f"- CASE WHEN {c} > 0 THEN {c} * ln({c}) ELSE 0 END" for c in a], ")"])


@query(
    "rf_split",
    f"""WITH h AS (SELECT l_linenumber AS node, l_quantity AS value, CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS r FROM lineitem GROUP BY ALL),
w AS (SELECT node, value, sum(a) OVER u AS la, sum(n) OVER u AS ln_, sum(r) OVER u AS lr, sum(a) OVER t AS ta, sum(n) OVER t AS tn, sum(r) OVER t AS tr FROM h WINDOW u AS (PARTITION BY node ORDER BY value), t AS (PARTITION BY node)),
x AS (SELECT *, la + ln_ + lr AS nl, ta + tn + tr AS nt FROM w),
g AS (SELECT node, value, round(({_IMP(['ta', 'tn', 'tr'], 'nt')} - {_IMP(['la', 'ln_', 'lr'], 'nl')} - {_IMP(['(ta - la)', '(tn - ln_)', '(tr - lr)'], '(nt - nl)')}) / nt, 9) AS gain FROM x WHERE nl < nt),
k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, value) AS k FROM g)
SELECT 0 AS tree, CAST(node AS BIGINT) AS node, CAST(0 AS BIGINT) AS feature, value AS threshold, round(gain, 6) AS gain FROM k WHERE k = 1""",
)
def rf_split(spark, d):
    h = table(spark, d, "lineitem").groupBy(F.lit(0).alias("tree"), F.col("l_linenumber").cast("long").alias("node"), F.lit(0).cast("long").alias("feature"), F.col("l_quantity").alias("value"), F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"))
    return R.splits(h, "label", ["A", "N", "R"]).withColumn("gain", F.round("gain", 6))


_MISS = lambda a, n: f"({n} - greatest({', '.join(a)}))"


@query(
    "rf_split_custom",
    f"""WITH h AS (SELECT l_linenumber AS node, l_quantity AS value, CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS r FROM lineitem GROUP BY ALL),
w AS (SELECT node, value, sum(a) OVER u AS la, sum(n) OVER u AS ln_, sum(r) OVER u AS lr, sum(a) OVER t AS ta, sum(n) OVER t AS tn, sum(r) OVER t AS tr FROM h WINDOW u AS (PARTITION BY node ORDER BY value), t AS (PARTITION BY node)),
x AS (SELECT *, la + ln_ + lr AS nl, ta + tn + tr AS nt FROM w),
g AS (SELECT node, value, round(({_MISS(['ta', 'tn', 'tr'], 'nt')} - {_MISS(['la', 'ln_', 'lr'], 'nl')} - {_MISS(['(ta - la)', '(tn - ln_)', '(tr - lr)'], '(nt - nl)')}) / nt, 9) AS gain FROM x WHERE nl < nt),
k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, value) AS k FROM g)
SELECT 0 AS tree, CAST(node AS BIGINT) AS node, CAST(0 AS BIGINT) AS feature, value AS threshold, round(gain, 6) AS gain FROM k WHERE k = 1""",
)
def rf_split_custom(spark, d):
    """Splits by an impurity of one's own: the share that a majority vote gets wrong."""
    h = table(spark, d, "lineitem").groupBy(F.lit(0).alias("tree"), F.col("l_linenumber").cast("long").alias("node"), F.lit(0).cast("long").alias("feature"), F.col("l_quantity").alias("value"), F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"))
    return R.splits(h, "label", ["A", "N", "R"], lambda counts, total: total - F.greatest(*counts)).withColumn("gain", F.round("gain", 6))


@query("rf_walk", "SELECT CASE WHEN l_quantity > 25 THEN CASE WHEN l_tax > 0.04 THEN 3 ELSE 2 END ELSE CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END END AS leaf, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY ALL")
def rf_walk(spark, d):
    x = table(spark, d, "lineitem").select(R.literal_walk(F.array("l_quantity", "l_discount", "l_tax"), TREE).alias("leaf"), F.col("l_returnflag").alias("label"))
    return x.groupBy("leaf", "label").agg(F.count("*").alias("n"))


@query("tree_step", "SELECT l_orderkey AS sample, CASE WHEN l_quantity > 25 THEN 2 ELSE 1 END AS node, count(*) AS n FROM lineitem GROUP BY ALL")
def tree_step(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), F.lit(0).alias("tree"), F.lit(0).cast("long").alias("node"), F.array("l_quantity").alias("xs"))
    nodes = spark.createDataFrame([(0, 0, 0, 25.0)], "tree int, node long, feature long, threshold double")
    return R.step(s, nodes).groupBy("sample", F.col("node").cast("int").alias("node")).agg(F.count("*").alias("n"))


@query("rf_fit_predict", None)
def rf_fit_predict(spark, d):
    from tallyforge.operators.evaluate import tally

    s = tree_samples(spark, d).persist()
    inner, leaves = R.grow(s, 3, "label", ["A", "N", "R"], trees=2, depth=2, least_gain=0.0001)
    leaves = kept(leaves, "leaves")
    s.unpersist()
    votes = R.predict(s, inner, leaves, depth=2, trees=2)
    return tally(votes, "sample", "vote").groupBy("vote").agg(F.count("*").alias("n"))


#: Two small forests over (quantity, discount, tax): (tree, node, feature, threshold, gain) and (tree, node, label).
FOREST_A = ([(0, 0, 0, 25.0, 0.0), (0, 1, 1, 0.05, 0.0), (0, 2, 2, 0.04, 0.0), (1, 0, 1, 0.03, 0.0)], [(0, 3, 0.0), (0, 4, 1.0), (0, 5, 2.0), (0, 6, 3.0), (1, 1, 1.5), (1, 2, 2.5)])
FOREST_B = ([(0, 0, 2, 0.02, 0.0)], [(0, 1, -1.0), (0, 2, 4.0)])
VOTES_A = "CASE WHEN l_quantity > 25 THEN CASE WHEN l_tax > 0.04 THEN 3.0 ELSE 2.0 END ELSE CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END END", "CASE WHEN l_discount > 0.03 THEN 2.5 ELSE 1.5 END"
VOTES_B = "CASE WHEN l_tax > 0.02 THEN 4.0 ELSE -1.0 END"
LINES = "lin AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS sample, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag FROM lineitem)"


def forest_tables(spark, forest):
    inner, leaves = forest
    return spark.createDataFrame(inner, "tree int, node long, feature long, threshold double, gain double"), spark.createDataFrame(leaves, "tree int, node long, label double")


def forest_votes(spark, d, inner, leaves, trees):
    return R.predict(tree_samples(spark, d).drop("label"), inner, leaves, 2, trees)


@query("rf_predict_mean", f"WITH {LINES}, v AS (SELECT sample, {VOTES_A[0]} AS a, {VOTES_A[1]} AS b FROM lin) SELECT sample, round(avg(x), 6) AS mean, round(stddev_pop(x), 5) AS std FROM (SELECT sample, a AS x FROM v UNION ALL SELECT sample, b FROM v) GROUP BY sample")
def rf_predict_mean(spark, d):
    """Regression: each sample walks both trees; mean of its leaves, and their spread."""
    v = forest_votes(spark, d, *forest_tables(spark, FOREST_A), 2)
    return v.groupBy("sample").agg(F.round(F.avg("vote"), 6).alias("mean"), F.round(F.stddev_pop("vote"), 5).alias("std"))


_MERGED = f"WITH {LINES}, v AS (SELECT 0 AS tree, {VOTES_A[0]} AS vote FROM lin UNION ALL SELECT 1, {VOTES_A[1]} FROM lin UNION ALL SELECT 2, {VOTES_B} FROM lin) "


@query("rf_merge", _MERGED + "SELECT tree, vote, count(*) AS n FROM v GROUP BY ALL")
def rf_merge(spark, d):
    """Two forests as one: the votes of all trees, those of the second under numbers after the first's."""
    (ia, la), (ib, lb) = forest_tables(spark, FOREST_A), forest_tables(spark, FOREST_B)
    return forest_votes(spark, d, R.merge(ia, ib), R.merge(la, lb), 3).groupBy("tree", "vote").agg(F.count("*").alias("n"))


@query("forest_save", _MERGED + "SELECT tree, vote, count(*) AS n FROM v WHERE tree < 2 GROUP BY ALL")
def forest_save(spark, d):
    """A forest written as a model directory and read back predicts as before."""
    from tallyforge.scratch import scratch
    from tallyforge.sources import files

    inner, leaves = forest_tables(spark, FOREST_A)
    path = scratch(spark, "forest")
    files.save_model(path, {"trees": 2, "depth": 2}, inner=inner, leaves=leaves)
    options, m = files.load_model(spark, path, "inner", "leaves")
    v = R.predict(tree_samples(spark, d).drop("label"), m["inner"], m["leaves"], options["depth"], options["trees"])
    return v.groupBy("tree", "vote").agg(F.count("*").alias("n"))


@query("gmm_demo", f"WITH {SAMPLES}, p AS (SELECT exp(-(f1 - 0.3) * (f1 - 0.3) / 0.02) AS a, exp(-(f1 - 0.7) * (f1 - 0.7) / 0.02) AS b FROM smp) SELECT round(sum(ln(0.5::DOUBLE * a + 0.5::DOUBLE * b)), 3) AS loglik, round(avg(a / (a + b)), 6) AS first, round(avg(b / (a + b)), 6) AS second FROM p")
def gmm_demo(spark, d):
    """Log likelihood of an even mixture of two, and how much of the samples each takes."""
    from tallyforge.operators.factor import mixture_loglik, mixture_posterior

    x, means = F.col("f1"), [0.3, 0.7]
    shares = [F.round(F.avg(mixture_posterior(x, means, 0.1, i)), 6).alias(n) for i, n in enumerate(("first", "second"))]
    return samples(spark, d).agg(F.round(F.sum(mixture_loglik(x, means, 0.1)), 3).alias("loglik"), *shares)


# Update rules ------------------------------------------------------------------------------------------------------


def model(spark, d):
    """(key, w, v, ss, g): a model table made of supplier keys by whole-number arithmetic."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("key"), ((k % 11 - 5) / 10.0).alias("w"), ((k % 7 - 3) / 100.0).alias("v"), ((k % 5) / 50.0).alias("ss"), ((k % 13 - 6) / 10.0).alias("g"))


MODEL = "mdl AS (SELECT s_suppkey AS key, (s_suppkey % 11 - 5) / 10.0::DOUBLE AS w, (s_suppkey % 7 - 3) / 100.0::DOUBLE AS v, (s_suppkey % 5) / 50.0::DOUBLE AS ss, (s_suppkey % 13 - 6) / 10.0::DOUBLE AS g FROM supplier)"


@query("up_grad", f"WITH {MODEL} SELECT key, round(w + 0.1::DOUBLE * pow(1 / 4.0::DOUBLE, 0.5) * (g - 0.01::DOUBLE * w), 8) AS w, round(w + 0.9::DOUBLE * v + 0.05::DOUBLE * g, 8) AS mw, round(0.9::DOUBLE * v + 0.05::DOUBLE * g, 8) AS mv, round(w + 0.9::DOUBLE * (0.9::DOUBLE * v + 0.05::DOUBLE * g) + 0.05::DOUBLE * g, 8) AS nw FROM mdl")
def up_grad(spark, d):
    w, v, g = F.col("w"), F.col("v"), F.col("g")
    mw, mv = U.Momentum(0.9).step(w, v, 0.05 * g)
    nw, _ = U.Momentum(0.9, True).step(w, v, 0.05 * g)
    r = lambda c, n: F.round(c, 8).alias(n)
    return model(spark, d).select("key", r(U.sgd(w, g, U.step_size(0.1, F.lit(4.0)), 0.01), "w"), r(mw, "mw"), r(mv, "mv"), r(nw, "nw"))


@query("up_clip", f"WITH {MODEL}, r AS (SELECT key % 2 AS m, sqrt(avg(g * g)) AS rms FROM mdl GROUP BY 1), a AS (SELECT sqrt(avg(g * g)) AS rms FROM mdl) SELECT key, greatest(-0.3::DOUBLE, least(0.3::DOUBLE, g)) AS by_value, round(CASE WHEN r.rms > 0.2 THEN g * 0.2 / r.rms ELSE g END, 8) AS by_matrix, round(CASE WHEN a.rms > 0.2 THEN g * 0.2 / a.rms ELSE g END, 8) AS by_all FROM mdl JOIN r ON m = key % 2, a")
def up_clip(spark, d):
    m = model(spark, d).withColumn("m", F.col("key") % 2).withColumn("g2", F.col("g"))
    m = U.clip_norm(U.clip_norm(m.withColumn("by_value", U.clip_value(F.col("g"), 0.3)), "m", "g", 0.2), None, "g2", 0.2)
    return m.select("key", "by_value", F.round("g", 8).alias("by_matrix"), F.round("g2", 8).alias("by_all"))


@query("up_natural", f"WITH {MODEL} SELECT key, round(0.5::DOUBLE * v + g, 8) AS pre FROM mdl")
def up_natural(spark, d):
    """Momentum taken on the gradient before the rule sees it."""
    _, v = U.Momentum(0.5).step(F.col("w"), F.col("v"), F.col("g"))
    return model(spark, d).select("key", F.round(v, 8).alias("pre"))


@query("up_lrpolicy", "SELECT event_id, round(CASE WHEN x <= 0.2 THEN 1.0 WHEN x <= 0.6 THEN 1.0 + (x - 0.2) / 0.4 * -0.5 ELSE 0.5 END, 8) AS straight, round(CASE WHEN x <= 0.2 THEN 1.0 WHEN x <= 0.6 THEN pow(0.5, (x - 0.2) / 0.4) ELSE 0.5 END, 8) AS curved FROM (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS x FROM events)")
def up_lrpolicy(spark, d):
    x = F.col("x")
    e = table(spark, d, "events").select("event_id", ((F.col("event_id") % 101) / 100.0).alias("x"))
    pts = [(0.2, 1.0), (0.6, 0.5)]
    return e.select("event_id", F.round(U.interpolated(x, pts), 8).alias("straight"), F.round(U.interpolated(x, pts, True), 8).alias("curved"))


@query("up_adagrad", f"WITH {MODEL}, s AS (SELECT *, 0.75::DOUBLE * ss + 0.25::DOUBLE * g * g AS s2, 0.9::DOUBLE * ss + 0.1::DOUBLE * g * g AS s3 FROM mdl) SELECT key, round(s2, 8) AS ss, round(w + 0.5::DOUBLE * g / pow(s2 + 1e-5::DOUBLE, 0.5), 7) AS w, round(w + 0.5::DOUBLE * g / pow(s3 + 1e-5::DOUBLE, 0.3), 7) AS wd FROM s")
def up_adagrad(spark, d):
    g, ss = F.col("g"), F.col("ss")
    s2, s3 = U.adagrad_state(ss, g, 3), U.adagrad_state(ss, g, 3, decay=0.9)
    return model(spark, d).select("key", F.round(s2, 8).alias("ss"), F.round(U.adagrad(F.col("w"), g, s2, 0.5), 7).alias("w"), F.round(U.adagrad(F.col("w"), g, s3, 0.5, 0.3), 7).alias("wd"))


@query("up_batch", f"WITH {SAMPLES} SELECT y, count(*) AS n, round(avg(f1), 8) AS m FROM smp GROUP BY y")
def up_batch(spark, d):
    """One update a pass: the engine's own form."""
    return samples(spark, d).groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg("f1"), 8).alias("m"))


@query("up_batchnorm", "WITH a AS (SELECT l_linenumber AS topic, l_suppkey AS feature, sum(CAST(l_quantity AS BIGINT)) AS num, count(*) AS den FROM lineitem GROUP BY ALL), q AS (SELECT topic, feature, num / CAST(den AS DOUBLE) AS v FROM a) SELECT topic, feature, round(v / sum(v) OVER (PARTITION BY topic), 9) AS w FROM q")
def up_batchnorm(spark, d):
    """Accumulated numerator by denominator, rows to one."""
    a = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("topic"), F.col("l_suppkey").alias("feature")).agg((F.sum(F.col("l_quantity").cast("long")) / F.count("*")).alias("v"))
    t = a.groupBy("topic").agg(F.sum("v").alias("t"))
    return a.join(F.broadcast(t), "topic").select("topic", "feature", F.round(F.col("v") / F.col("t"), 9).alias("w"))


_FOLD = "WITH RECURSIVE n AS (SELECT user_id, {v} AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), r AS (SELECT user_id, k, pow({f}::DOUBLE / 1, 0.3) * value + (1 - pow({f}::DOUBLE / 1, 0.3)) * 0 AS m FROM n WHERE k = 1 UNION ALL SELECT n.user_id, n.k, (1 - pow({f}::DOUBLE / n.k, 0.3)) * r.m + pow({f}::DOUBLE / n.k, 0.3) * n.value FROM r JOIN n ON n.user_id = r.user_id AND n.k = r.k + 1) SELECT user_id, round({o}, 5) AS m FROM r GROUP BY user_id"


@query("up_incnorm", _FOLD.format(v="value", f="0.99", o="last(m ORDER BY k)"))
def up_incnorm(spark, d):
    return U.weighted_fold(table(spark, d, "events"), "user_id", "event_id", "value", 0.3).select("user_id", F.round("average", 5).alias("m"))


@query("up_incmult", _FOLD.format(v="ln(value + 1)", f="1.0", o="exp(last(m ORDER BY k))"))
def up_incmult(spark, d):
    e = table(spark, d, "events").withColumn("v", F.col("value") + 1)
    return U.geometric_fold(e, "user_id", "event_id", "v", 0.3).select("user_id", F.round("average", 5).alias("m"))


@query("up_telescoping", "WITH b AS (SELECT event_id // 100 + 1 AS step, sum(CAST(round(value * 100) AS BIGINT)) AS s, count(*) AS n FROM events GROUP BY 1), c AS (SELECT step, sum(s) OVER (ORDER BY step) AS s, sum(n) OVER (ORDER BY step) AS n FROM b) SELECT step, round(s / CAST(n AS DOUBLE), 6) AS m FROM c WHERE step IN (1, 2, 3, 5, 8, 11, 17, 26, 38, 58, 86)")
def up_telescoping(spark, d):
    from tallyforge.operators.ordering import running_sums

    b = table(spark, d, "events").groupBy((F.floor(F.col("event_id") / 100) + 1).alias("step")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("s"), F.count("*").alias("n"))
    c = running_sums(running_sums(b, ("step",), F.col("s"), "upto"), ("step",), F.col("n"), "count")
    return c.where(F.col("step").isin(U.telescope_steps(100))).select("step", F.round(F.col("upto") / F.col("count"), 6).alias("m"))


@query("mix_l1_l2", f"WITH {MODEL} SELECT key, round(-0.01::DOUBLE * sign(w), 8) + 0.0::DOUBLE AS l1, round(-0.01::DOUBLE * w, 8) + 0.0::DOUBLE AS l2 FROM mdl")
def mix_l1_l2(spark, d):
    return model(spark, d).select("key", F.round(U.l1(F.col("w"), 0.01), 8).alias("l1"), F.round(U.l2(F.col("w"), 0.01), 8).alias("l2"))


@query("mix_scores", f"WITH {MODEL} SELECT round(avg(abs(w)), 8) AS l1, round(avg(w * w), 8) AS l2 FROM mdl")
def mix_scores(spark, d):
    return model(spark, d).agg(F.round(F.avg(F.abs("w")), 8).alias("l1"), F.round(F.avg(F.col("w") * F.col("w")), 8).alias("l2"))


TOPICS = "tpc AS (SELECT l_linenumber AS topic, l_suppkey AS feature, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY ALL)"


def topics(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("topic"), F.col("l_suppkey").alias("feature")).agg(F.count("*").cast("double").alias("w"))


@query("mix_cosine", f"WITH {TOPICS}, n AS (SELECT topic, sqrt(sum(w * w)) AS n FROM tpc GROUP BY topic) SELECT a.topic AS t1, b.topic AS t2, round(sum(a.w * b.w) / (max(x.n) * max(z.n)), 8) AS cos FROM tpc a JOIN tpc b ON a.feature = b.feature AND a.topic < b.topic JOIN n x ON x.topic = a.topic JOIN n z ON z.topic = b.topic GROUP BY ALL")
def mix_cosine(spark, d):
    from tallyforge.operators.factor import topic_cosines

    return topic_cosines(topics(spark, d)).select("t1", "t2", F.round("cos", 8).alias("cos"))


@query("mix_perplexity", f"WITH {TOPICS}, t AS (SELECT topic, sum(w) AS t FROM tpc GROUP BY topic) SELECT topic, round(-sum(w / t * ln(w / t)), 7) AS entropy FROM tpc JOIN t USING (topic) GROUP BY topic")
def mix_perplexity(spark, d):
    t = topics(spark, d)
    s = t.groupBy("topic").agg(F.sum("w").alias("t"), F.sum(F.col("w") * F.ln("w")).alias("s"))
    return s.select("topic", F.round(F.ln("t") - F.col("s") / F.col("t"), 7).alias("entropy"))


@query("mix_top", f"WITH {TOPICS}, t AS (SELECT topic, sum(w) AS t FROM tpc GROUP BY topic) SELECT topic, feature, CASE WHEN w / t < 0.009 THEN -0.1::DOUBLE * w ELSE 0.0 END AS penalty FROM tpc JOIN t USING (topic)")
def mix_top(spark, d):
    t = topics(spark, d)
    j = t.join(F.broadcast(t.groupBy("topic").agg(F.sum("w").alias("t"))), "topic")
    return j.select("topic", "feature", F.when(F.col("w") / F.col("t") < 0.009, -0.1 * F.col("w")).otherwise(0.0).alias("penalty"))
