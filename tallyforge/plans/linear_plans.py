"""Products, aggregates, windows, sorts and scalar functions over the tables."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import arrays as A
from tallyforge.functions import special as S
from tallyforge.operators import evaluate as E
from tallyforge.operators import linear as L
from tallyforge.plans.catalog import query
from tallyforge.scratch import kept
from tallyforge.plans.fixtures import LONG, RATINGS, SAMPLES, TOKENS, counts, dense, ratings, samples, table

LABELS = "lab AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)"


def labels(spark, d):
    return table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))


def _uni(key: str, n: str) -> str:
    """The draw number n of a key: 32 bits of a digest, in (0, 1)."""
    return f"((CAST('0x' || substr(md5(CAST(({key}) AS VARCHAR) || ':' || CAST(({n}) AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


@query("spmm", f"WITH {RATINGS} SELECT \"user\" AS sample, t AS target, round(sum(rating * p_retailprice * (t + 1)) / 100000, 6) AS value FROM rat JOIN part ON p_partkey = item, (VALUES (0), (1)) g(t) GROUP BY ALL")
def spmm(spark, d):
    data = ratings(spark, d).select(F.col("user").alias("sample"), F.col("item").alias("feature"), F.col("rating").alias("x"))
    model = table(spark, d, "part").select(F.col("p_partkey").alias("feature"), F.explode(F.array(F.lit(0), F.lit(1))).alias("target"), "p_retailprice").withColumn("w", F.col("p_retailprice") * (F.col("target") + 1))
    return L.spmm(data, model.select("feature", "target", "w")).select("sample", "target", F.round(F.col("value") / 100000, 6).alias("value"))


@query("spmm_t", f"WITH {TOKENS}, {LABELS} SELECT quality AS target, tok AS feature, count(*) AS value FROM tok JOIN lab USING (doc_id) GROUP BY ALL")
def spmm_t(spark, d):
    data = counts(spark, d).select(F.col("doc_id").alias("sample"), F.col("tok").alias("feature"), F.col("cnt").alias("x"))
    eta = labels(spark, d).select(F.col("doc_id").alias("sample"), F.col("quality").alias("target"), F.lit(1).cast("long").alias("e"))
    return L.spmm_t(data, eta)


@query("sddmm", f'WITH {RATINGS} SELECT "user" AS "row", item AS col, rating AS value, round((("user" % 7) * (item % 5) + ("user" % 3) * (item % 11)) / 10.0, 6) AS dot FROM rat')
def sddmm(spark, d):
    r = ratings(spark, d).select(F.col("user").alias("row"), F.col("item").alias("col"), F.col("rating").alias("value"))
    left = r.select("row").distinct().withColumn("l", F.array((F.col("row") % 7).cast("double"), (F.col("row") % 3).cast("double")))
    right = r.select("col").distinct().withColumn("r", F.array((F.col("col") % 5).cast("double"), (F.col("col") % 11).cast("double")))
    return L.sddmm(r, left, right).withColumn("dot", F.round(F.col("dot") / 10.0, 6)).select("row", "col", "value", "dot")


@query("pair_dist", f"WITH {LONG}, c AS (SELECT vec_id AS cid, i, x FROM lng WHERE vec_id < 4) SELECT vec_id, cid, round(sum((lng.x - c.x) * (lng.x - c.x)), 5) AS d2 FROM lng JOIN c USING (i) GROUP BY ALL")
def pair_dist(spark, d):
    e = dense(spark, d, 1, 64)
    c = e.where("vec_id < 4").select(F.col("vec_id").alias("cid"), F.col("x").alias("c"))
    d2 = A.norm2(F.col("x")) + A.norm2(F.col("c")) - 2.0 * A.dot(F.col("x"), F.col("c"))
    return e.crossJoin(F.broadcast(c)).select("vec_id", "cid", F.round(d2, 5).alias("d2"))


@query("pair_cross", "WITH p AS (SELECT l_orderkey AS sample, l_partkey AS f, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY ALL) SELECT a.sample, a.f AS f1, b.f AS f2, a.v * b.v AS value FROM p a JOIN p b ON a.sample = b.sample AND a.f >= b.f")
def pair_cross(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample"), F.col("l_partkey").alias("f")).agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))
    return L.pair_cross(p, "sample", "f", "v")


@query(
    "hash_cross",
    """WITH p AS (SELECT l_orderkey AS sample, l_partkey AS f, count(*) AS v FROM lineitem GROUP BY ALL),
x AS (SELECT a.sample, ((((((0 + a.f) * 1103515245 + 12345) % 2147483648) + b.f) * 1103515245 + 12345) % 2147483648) // 64 % 10007 AS bucket, a.v * b.v AS v FROM p a JOIN p b ON a.sample = b.sample AND a.f > b.f)
SELECT sample, bucket, CAST(sum(v) AS BIGINT) AS value FROM x GROUP BY ALL""",
)
def hash_cross(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample"), F.col("l_partkey").alias("f")).agg(F.count("*").alias("v"))
    x = L.pair_cross(p, "sample", "f", "v", with_self=False)
    return x.groupBy("sample", S.arithmetic_hash([F.col("f1"), F.col("f2")], 10007).alias("bucket")).agg(F.sum("value").alias("value"))


@query("zip_sources", "SELECT o_orderkey AS k, o_totalprice AS price, c_mktsegment AS segment FROM orders JOIN customer ON c_custkey = o_custkey")
def zip_sources(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("c_mktsegment").alias("segment"))


@query("select_index", "SELECT vec_id, CAST(embedding[label + 1] AS DOUBLE) AS picked FROM embeddings")
def select_index(spark, d):
    return L.select_row(dense(spark, d, 1, 64), "x", "label").select("vec_id", "picked")


# Aggregates --------------------------------------------------------------------------------------------------------


@query("sum_rows_cols", f"WITH {LONG} SELECT i, round(sum(x), 5) AS s, round(avg(x), 5) AS m, round(var_samp(x), 5) AS v, round(sqrt(sum(x * x)), 5) AS norm FROM lng GROUP BY i")
def sum_rows_cols(spark, d):
    x = dense(spark, d, 1, 64).select(F.posexplode("x").alias("i", "x"))
    return x.groupBy((F.col("i") + 1).alias("i")).agg(F.round(F.sum("x"), 5).alias("s"), F.round(F.avg("x"), 5).alias("m"), F.round(F.var_samp("x"), 5).alias("v"), F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 5).alias("norm"))


@query("sort_run_count", "SELECT l_suppkey, l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
def sort_run_count(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber", "l_returnflag").agg(F.count("*").alias("n"))


@query("log_merge", "SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS s FROM events GROUP BY 1")
def log_merge(spark, d):
    """Partial counts of pieces, merged: the engine's own partial and final aggregation."""
    parts = table(spark, d, "events").groupBy("event_type", (F.col("event_id") % 16).alias("piece")).agg(F.count("*").alias("n"), F.sum("user_id").alias("s"))
    return parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


@query("tally", "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM n) SELECT user_id, event_type FROM r WHERE k = 1")
def tally(spark, d):
    return E.tally(table(spark, d, "events"), "user_id", "event_type")


for _name, _smooth in (("glm", 0.5), ("factor", 1.0)):

    @query(f"corpus_perplexity_{_name}", f"WITH {TOKENS}, c AS (SELECT tok, count(*) + {_smooth}::DOUBLE AS c FROM tok GROUP BY tok) SELECT round(exp(ln(sum(c)) - sum(c * ln(c)) / sum(c)), 4) AS perplexity FROM c")
    def _perplexity(spark, d, smooth=_smooth):
        return E.corpus_perplexity(counts(spark, d), "tok", "cnt", smooth).select(F.round("perplexity", 4).alias("perplexity"))


@query("score_summary", f"WITH {SAMPLES}, b AS (SELECT (row_number() OVER (ORDER BY id) - 1) // 500 AS b, f1 FROM smp), s AS (SELECT b, avg(f1) AS score FROM b GROUP BY b), m AS (SELECT max(b) AS m FROM s) SELECT round(avg(score), 6) AS every, round(avg(CASE WHEN b >= m / 2.0 THEN score END), 6) AS half, round(avg(CASE WHEN b >= 3 * m / 4.0 THEN score END), 6) AS quarter, round(avg(CASE WHEN b = m THEN score END), 6) AS last FROM s, m")
def score_summary(spark, d):
    from tallyforge.operators.transform import batches

    s = batches(samples(spark, d), ("id",), 500).groupBy("batch_id").agg(F.avg("f1").alias("score"))
    s = s.crossJoin(s.agg(F.max("batch_id").alias("m")))
    pick = lambda c: F.round(F.avg(F.when(c, F.col("score"))), 6)
    b, m = F.col("batch_id"), F.col("m")
    return s.agg(F.round(F.avg("score"), 6).alias("every"), pick(b >= m / 2).alias("half"), pick(b >= 3 * m / 4).alias("quarter"), pick(b == m).alias("last"))


@query("roc_auc", f"WITH {SAMPLES}, s AS (SELECT round(f2 * 1000) AS s, y FROM smp), r AS (SELECT s, y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS k FROM s) SELECT round((sum(CASE WHEN y = 1 THEN k ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 8) AS auc FROM r")
def roc_auc(spark, d):
    s = samples(spark, d).select(F.round(F.col("f2") * 1000).alias("s"), "y")
    return E.auc(s, "s", "y").select(F.round("auc", 8).alias("auc"))


@query("roc_points", f"WITH {SAMPLES}, s AS (SELECT CAST(round(f2 * 1000) AS BIGINT) AS s, sum(y) AS p, sum(1 - y) AS q FROM smp GROUP BY 1) SELECT s, round(sum(p) OVER w / sum(p) OVER (), 8) AS tpr, round(sum(q) OVER w / sum(q) OVER (), 8) AS fpr FROM s WINDOW w AS (ORDER BY s DESC)")
def roc_points(spark, d):
    s = samples(spark, d).select(F.round(F.col("f2") * 1000).cast("long").alias("s"), "y")
    return E.roc_points(s, "s", "y").select("s", F.round("tpr", 8).alias("tpr"), F.round("fpr", 8).alias("fpr"))


@query(
    "naive_bayes",
    f"""WITH {TOKENS}, {LABELS}, c AS (SELECT tok, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) + 0.5::DOUBLE AS p, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) + 0.5::DOUBLE AS q FROM tok JOIN lab USING (doc_id) GROUP BY tok),
t AS (SELECT sum(p) AS tp, sum(q) AS tq FROM c), w AS (SELECT tok, ln(p / tp) - ln(q / tq) AS w FROM c, t)
SELECT doc_id, round(sum(w), 4) AS log_odds, round(1 / (1 + exp(-greatest(least(sum(w), 30), -30))), 4) AS prob FROM tok JOIN w USING (tok) GROUP BY doc_id""",
)
def naive_bayes(spark, d):
    from tallyforge.operators.classify import naive_bayes_scores, naive_bayes_weights

    c = kept(counts(spark, d), "counts")
    w = naive_bayes_weights(c.join(labels(spark, d), "doc_id"), "tok", "cnt", "quality")
    s = naive_bayes_scores(c, w, "doc_id", "tok", "cnt")
    return s.select("doc_id", F.round("log_odds", 4).alias("log_odds"), F.round(S.logistic(F.greatest(F.least("log_odds", F.lit(30.0)), F.lit(-30.0))), 4).alias("prob"))


@query("rmse_mae", f"WITH {RATINGS}, m AS (SELECT item, avg(rating) AS m FROM rat GROUP BY item) SELECT round(sqrt(avg((rating - m) * (rating - m))), 6) AS rmse, round(avg(abs(rating - m)), 6) AS mae FROM rat JOIN m USING (item)")
def rmse_mae(spark, d):
    r = ratings(spark, d)
    j = r.join(r.groupBy("item").agg(F.avg("rating").alias("m")), "item")
    return j.agg(F.round(E.rmse(F.col("rating"), F.col("m")), 6).alias("rmse"), F.round(E.mae(F.col("rating"), F.col("m")), 6).alias("mae"))


@query("accuracy", f"WITH {SAMPLES} SELECT round(avg(CASE WHEN (f1 > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 8) AS accuracy, round(avg(f2 * y + (1 - f2) * (1 - y)), 8) AS soft FROM smp")
def accuracy(spark, d):
    return samples(spark, d).agg(F.round(E.accuracy(F.col("f1") > 0.5, F.col("y") == 1), 8).alias("accuracy"), F.round(E.soft_accuracy(F.col("f2"), F.col("y")), 8).alias("soft"))


@query("logloss", f"WITH {SAMPLES}, s AS (SELECT y, 1 / (1 + exp(-greatest(least((f1 - 0.5) * 20, 7), -7))) AS p FROM smp) SELECT round(avg(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS ll FROM s")
def logloss(spark, d):
    return samples(spark, d).agg(F.round(E.log_loss(F.col("y"), (F.col("f1") - 0.5) * 20), 6).alias("ll"))


@query("sample_cov", f"WITH {LONG}, e AS (SELECT * FROM lng WHERE i <= 8) SELECT a.i, b.i AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL")
def sample_cov(spark, d):
    from tallyforge.operators.decompose import covariance

    return covariance(dense(spark, d, 1, 8), "x", 8).select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), F.round("value", 6).alias("cov"))


@query("gram", f"WITH {LONG}, e AS (SELECT * FROM lng WHERE i <= 8) SELECT a.i, b.i AS j, round(sum(a.x * b.x), 5) AS g FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL")
def gram(spark, d):
    return L.gram_arrays(dense(spark, d, 1, 8), "x", 8).select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), F.round("value", 5).alias("g"))


# Windows -----------------------------------------------------------------------------------------------------------


@query("cumsum", "SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS cents FROM events")
def cumsum(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("event_id", F.sum(F.round(F.col("value") * 100).cast("long")).over(w).alias("cents"))


@query("run_boundaries", "WITH c AS (SELECT event_id, user_id, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM c")
def run_boundaries(spark, d):
    return L.run_boundaries(table(spark, d, "events"), ("event_id",), "event_type", ("user_id",)).select("event_id", "run")


@query("prefix_hist", "WITH h AS (SELECT CAST(l_quantity AS BIGINT) AS v, l_returnflag AS c, count(*) AS n FROM lineitem GROUP BY ALL) SELECT v, c, CAST(sum(n) OVER (PARTITION BY c ORDER BY v) AS BIGINT) AS upto FROM h")
def prefix_hist(spark, d):
    h = table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("v"), F.col("l_returnflag").alias("c")).agg(F.count("*").alias("n"))
    return h.select("v", "c", F.sum("n").over(Window.partitionBy("c").orderBy("v")).alias("upto"))


@query("smooth", "SELECT event_id // 50 AS block, round(avg(value), 6) AS m FROM events GROUP BY 1")
def smooth(spark, d):
    return table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 50).cast("long").alias("block")).agg(F.round(F.avg("value"), 6).alias("m"))


@query("moving_avg", "WITH RECURSIVE n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), r AS (SELECT user_id, k, value AS m FROM n WHERE k = 1 UNION ALL SELECT n.user_id, n.k, 0.9 * r.m + 0.1 * n.value FROM r JOIN n ON n.user_id = r.user_id AND n.k = r.k + 1) SELECT user_id, round(last(m ORDER BY k), 5) AS m FROM r GROUP BY user_id")
def moving_avg(spark, d):
    from tallyforge.operators.updaters import exponential_average

    e = table(spark, d, "events")
    return exponential_average(e, "user_id", "event_id", "value", 0.9).select("user_id", F.round("average", 5).alias("m"))


# Sorts -------------------------------------------------------------------------------------------------------------


@query("sort_perm", "SELECT p_partkey AS k, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS place FROM part")
def sort_perm(spark, d):
    from tallyforge.operators.ordering import row_numbers

    p = row_numbers(table(spark, d, "part").select("p_retailprice", "p_partkey"), ("p_retailprice", "p_partkey"), "place")
    return p.select(F.col("p_partkey").alias("k"), (F.col("place") + 1).alias("place"))


@query("sort_lex", "SELECT DISTINCT p_brand, p_type, p_size, dense_rank() OVER (ORDER BY p_brand, p_type, p_size) AS place FROM part")
def sort_lex(spark, d):
    from tallyforge.operators.ordering import row_numbers

    rows = table(spark, d, "part").select("p_brand", "p_type", "p_size").distinct()
    return row_numbers(rows, ("p_brand", "p_type", "p_size"), "place").withColumn("place", F.col("place") + 1)


@query("argmax", f"WITH {LONG} SELECT vec_id, max(x) AS top, min(i) FILTER (WHERE x = m) AS top_at, min(x) AS low, min(i) FILTER (WHERE x = n) AS low_at FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m, min(x) OVER (PARTITION BY vec_id) AS n FROM lng) GROUP BY vec_id")
def argmax(spark, d):
    x = F.col("x")
    return dense(spark, d, 1, 64).select("vec_id", F.array_max(x).alias("top"), (A.argmax(x) + 1).alias("top_at"), F.array_min(x).alias("low"), (A.argmin(x) + 1).alias("low_at"))


@query("randperm", f"SELECT p_partkey AS k, row_number() OVER (ORDER BY {_uni('p_partkey', '7')}, p_partkey) - 1 AS place FROM part")
def randperm(spark, d):
    """All rows in a random order that the keys fix: each row's place in it."""
    from tallyforge.functions import sampling
    from tallyforge.operators.ordering import row_numbers

    p = table(spark, d, "part").select(F.col("p_partkey").alias("k")).withColumn("u", sampling.uniform(F.col("k"), 7))
    return row_numbers(p, ("u", "k"), "place").drop("u")


@query("vcat_hcat", "SELECT vec_id, CAST(len(embedding[1:4]) + len(embedding[9:12]) AS INTEGER) AS n, round(list_sum(list_transform(embedding[1:4] || embedding[9:12], lambda v: CAST(v AS DOUBLE))), 6) AS s FROM embeddings")
def vcat_hcat(spark, d):
    a, b = dense(spark, d, 1, 4, "a"), dense(spark, d, 9, 4, "b").drop("label")
    j = a.join(b, "vec_id").withColumn("x", F.concat("a", "b"))
    half = j.where("vec_id % 2 = 0").unionByName(j.where("vec_id % 2 <> 0"))
    return half.select("vec_id", F.size("x").alias("n"), F.round(A.total(F.col("x")), 6).alias("s"))


@query("packed_sort", "SELECT l_suppkey * 1000 + l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY 1")
def packed_sort(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_suppkey") * 1000 + F.col("l_linenumber")).alias("key")).agg(F.count("*").alias("n")).orderBy("key")


# Scalar functions --------------------------------------------------------------------------------------------------


@query(
    "math_functions",
    """SELECT p_partkey AS k, round(exp(v), 6) AS e, round(ln(v + 1), 6) AS l, round(sqrt(v), 6) AS r, round(abs(v - 1), 6) AS a, CAST(sign(v - 1) AS DOUBLE) AS s, round(tanh(v), 6) AS t, round(cosh(v), 6) AS c,
round(ln(cosh(v)), 6) AS lc, round(ln(1 + exp(v)), 6) AS sp, round(1 / (1 + exp(-v)), 6) AS lg, CASE WHEN v * 10 > 16 THEN 1.0 ELSE round(1 / (1 + exp(-v * 10)), 6) END AS gl, floor(v) AS fl, round(sin(v), 6) AS si, round(cos(v), 6) AS co, round(pow(v, 1.5), 6) AS pw, round(lgamma(v + 0.1), 6) AS lgam
FROM (SELECT p_partkey, p_retailprice / 1000.0::DOUBLE AS v FROM part)""",
)
def math_functions(spark, d):
    v = F.col("v")
    r = lambda c, n: F.round(c, 6).alias(n)
    return (
        table(spark, d, "part")
        .select("p_partkey", (F.col("p_retailprice") / 1000.0).alias("v"))
        .select(
            F.col("p_partkey").alias("k"), r(F.exp(v), "e"), r(F.ln(v + 1), "l"), r(F.sqrt(v), "r"), r(F.abs(v - 1), "a"), F.signum(v - 1).alias("s"), r(F.tanh(v), "t"), r(F.cosh(v), "c"),
            r(S.log_cosh(v), "lc"), r(S.softplus(v), "sp"), r(S.logistic(v), "lg"), r(S.guarded_logistic(v * 10), "gl"), F.floor(v).cast("double").alias("fl"), r(F.sin(v), "si"), r(F.cos(v), "co"), r(F.pow(v, F.lit(1.5)), "pw"), r(S.lgamma(v + 0.1), "lgam"),
        )
    )


@query(
    "digamma",
    """WITH v AS (SELECT p_partkey AS k, p_retailprice / 1000.0::DOUBLE AS v FROM part)
SELECT k, round((lgamma(v + 1e-5) - lgamma(v - 1e-5)) / 2e-5, 4) AS psi FROM v""",
)
def digamma(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.round(S.digamma(F.col("p_retailprice") / 1000.0), 4).alias("psi"))


@query("inverse_digamma", "SELECT p_partkey AS k, round(p_retailprice / 1000.0::DOUBLE - 1.00003::DOUBLE, 3) + 0.0::DOUBLE AS y FROM part")
def inverse_digamma(spark, d):
    """x of y, and y again as the slope of ln gamma there: no digamma is used on the way back."""
    x = S.inverse_digamma(F.col("p_retailprice") / 1000.0 - 1.00003)
    slope = (S.lgamma(F.col("x") + 1e-4) - S.lgamma(F.col("x") - 1e-4)) / 2e-4
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), x.alias("x")).select("k", (F.round(slope, 3) + 0.0).alias("y"))


@query("erfc", "WITH v AS (SELECT p_partkey AS k, p_retailprice / 1000.0::DOUBLE - 1.0::DOUBLE AS v FROM part) SELECT k, round(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 40), lambda n: pow(-1.0::DOUBLE, n) * pow(v, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))), 4) AS v FROM v")
def erfc(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.round(S.erfc(F.col("p_retailprice") / 1000.0 - 1.0), 4).alias("v"))


@query(
    "impurity",
    """WITH h AS (SELECT l_suppkey AS k, CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS r FROM lineitem GROUP BY 1)
SELECT k, round(-(CASE WHEN a > 0 THEN a / t * ln(a / t) ELSE 0 END + CASE WHEN n > 0 THEN n / t * ln(n / t) ELSE 0 END + CASE WHEN r > 0 THEN r / t * ln(r / t) ELSE 0 END), 6) AS entropy, round(1 - (a * a + n * n + r * r) / (t * t), 6) AS gini FROM (SELECT *, a + n + r AS t FROM h)""",
)
def impurity(spark, d):
    n = lambda f: F.sum(F.when(F.col("l_returnflag") == f, 1.0).otherwise(0.0))
    h = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.array(n("A"), n("N"), n("R")).alias("h"))
    return h.select("k", F.round(S.entropy(F.col("h")), 6).alias("entropy"), F.round(S.gini(F.col("h")), 6).alias("gini"))


_TIMES = lambda x, k: f"CAST(CAST({x} AS HUGEINT) * {k} % 4294967296 AS BIGINT)"
_TURN = lambda x, r: f"(({x} * {2**r}) % 4294967296 + {x} // {2 ** (32 - r)})"


def _mix_sql(source: str, h: str, k: str, out: str) -> str:
    """Two CTEs: a hash h mixed with a key k, by products of 128 bits."""
    return f"""{out}a AS (SELECT *, xor({h}, {_TIMES(_TURN("kk", 15), 0x1B873593)}) AS hh FROM (SELECT *, {_TIMES(k, 0xCC9E2D51)} AS kk FROM {source})),
{out} AS (SELECT * EXCLUDE (kk, hh), ({_TIMES(_TURN("hh", 13), 5)} + {0xE6546B64}) % 4294967296 AS {out}h FROM {out}a)"""


@query("murmur_mix", f"WITH o AS (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders), {_mix_sql('o', 'o_orderkey', 'o_custkey', 'x')}, {_mix_sql('x', 'xh', 'price', 'y')} SELECT o_orderkey AS k, abs((CASE WHEN yh >= 2147483648 THEN yh - 4294967296 ELSE yh END) % 97) AS h FROM y")
def murmur_mix(spark, d):
    """The 32-bit hash by which a forest picks features: three numbers mixed, below 97."""
    parts = [F.col("o_orderkey"), F.col("o_custkey"), F.floor("o_totalprice").cast("long")]
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), S.murmur_hash(parts, 97).alias("h"))


@query("arithmetic_hash", "SELECT o_orderkey AS k, ((((((o_orderkey * 1103515245 + 12345) % 2147483648) + o_custkey) * 1103515245 + 12345) % 2147483648) // 64) % 97 AS h FROM orders")
def arithmetic_hash(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), S.arithmetic_hash([F.col("o_orderkey"), F.col("o_custkey")], 97).alias("h"))


@query("quantised", "SELECT p_partkey AS k, CAST(least(greatest(floor((p_retailprice - 0) / 3000.0 * 65536), 0), 65535) AS BIGINT) AS v FROM part")
def quantised(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), S.quantised(F.col("p_retailprice"), 16, 0.0, 3000.0).alias("v"))


@query(
    "ordered_bits",
    """WITH x AS (SELECT s_suppkey AS k, CAST(CAST(s_acctbal AS FLOAT) AS DOUBLE) AS x FROM supplier), e AS (SELECT *, list_max(list_filter(range(-126, 128), lambda e: pow(2.0::DOUBLE, e) <= abs(x))) AS e FROM x),
m AS (SELECT k, x, CASE WHEN e IS NULL THEN 0 ELSE (e + 127) * 8388608 + CAST((abs(x) / pow(2.0::DOUBLE, e) - 1) * 8388608 AS BIGINT) END AS m FROM e) SELECT k, CAST(((CASE WHEN x < 0 THEN -m ELSE m END) + 2147483648) // 65536 AS BIGINT) AS v FROM m""",
)
def ordered_bits(spark, d):
    """The top 16 bits of a single-precision number, in the order of the numbers."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), S.ordered_bits(F.col("s_acctbal").cast("double"), 16).alias("v"))


@query("countbits", "SELECT o_orderkey AS k, CAST(bit_count(o_custkey) AS INTEGER) AS n FROM orders")
def countbits(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.bit_count("o_custkey").cast("int").alias("n"))


@query("pack_fields", "SELECT l_orderkey * 8 + l_linenumber AS k, l_suppkey * 1048576 + CAST(l_quantity AS BIGINT) * 1024 + l_linenumber AS packed, l_suppkey AS a, CAST(l_quantity AS BIGINT) AS b, CAST(l_linenumber AS BIGINT) AS c FROM lineitem")
def pack_fields(spark, d):
    """Three fields in one number, and out of it again."""
    widths, line = [30, 10, 10], table(spark, d, "lineitem")
    p = line.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), A.packed([F.col("l_suppkey"), F.col("l_quantity"), F.col("l_linenumber")], widths).alias("packed"))
    return p.select("k", "packed", *[c.alias(n) for c, n in zip(A.unpacked(F.col("packed"), widths), "abc")])


_POISSON = [sum(math.exp(-2.5) * 2.5**i / math.factorial(i) for i in range(k + 1)) for k in range(25)]


@query(
    "samplers",
    f"""SELECT o_orderkey AS k, round({_uni('o_orderkey', '0')}, 8) AS u, round(sqrt(-2 * ln({_uni('o_orderkey', '0')})) * cos(2 * pi() * {_uni('o_orderkey', '1')}), 6) + 0.0::DOUBLE AS z, round(-ln({_uni('o_orderkey', '0')}) / 2.0, 6) AS e,
round(-list_sum(list_transform(range(0, 3), lambda i: ln({_uni('o_orderkey', 'i')}))), 6) AS g, CAST(list_sum(list_transform(range(0, 8), lambda i: CASE WHEN {_uni('o_orderkey', 'i')} < 0.3 THEN 1 ELSE 0 END)) AS INTEGER) AS b,
CAST(len(list_filter({_POISSON}::DOUBLE[], lambda c: {_uni('o_orderkey', '0')} > c)) AS INTEGER) AS p, CASE WHEN {_uni('o_orderkey', '0')} > 0.75 THEN 2 WHEN {_uni('o_orderkey', '0')} > 0.25 THEN 1 ELSE 0 END AS m FROM orders""",
)
def samplers(spark, d):
    """Draws from each row's key: uniform, normal, exponential, gamma, binomial, Poisson, and a place by weights."""
    from tallyforge.functions import sampling

    k = F.col("o_orderkey")
    r = lambda c, n: (F.round(c, 6) + 0.0).alias(n)
    return table(spark, d, "orders").select(k.alias("k"), F.round(sampling.uniform(k), 8).alias("u"), r(sampling.normal(k), "z"), r(sampling.exponential(k, 2.0), "e"), r(sampling.gamma(k, 3), "g"), sampling.binomial(k, 8, 0.3).alias("b"), sampling.poisson(k, 2.5).alias("p"), sampling.multinomial(k, [1.0, 2.0, 1.0]).alias("m"))


@query("array_functions", f"WITH {LONG}, p AS (SELECT a.vec_id, a.i, a.x, b.x AS y FROM lng a JOIN lng b ON a.vec_id = b.vec_id AND b.i = a.i + 4 WHERE a.i <= 4) SELECT vec_id, round(sum(x * y), 6) AS dot, round(sum(x * x), 6) AS norm2, round(sum((x - y) * (x - y)), 6) AS d2, round(sum(x) * sum(y), 6) AS kron_sum FROM p GROUP BY vec_id")
def array_functions(spark, d):
    e = dense(spark, d, 1, 8).select("vec_id", F.slice("x", 1, 4).alias("a"), F.slice("x", 5, 4).alias("b"))
    a, b = F.col("a"), F.col("b")
    return e.select("vec_id", F.round(A.dot(a, b), 6).alias("dot"), F.round(A.norm2(a), 6).alias("norm2"), F.round(A.squared_distance(a, b), 6).alias("d2"), F.round(A.total(A.outer(a, b)), 6).alias("kron_sum"))


@query("string_functions", "SELECT c_custkey AS k, lower(c_mktsegment) AS lo, upper(c_name) AS up, CAST(len(string_split(c_name, '#')) AS INTEGER) AS parts FROM customer")
def string_functions(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lower("c_mktsegment").alias("lo"), F.upper("c_name").alias("up"), F.size(F.split("c_name", "#")).alias("parts"))


@query("date_parse", "SELECT o_orderkey AS k, epoch(date_trunc('day', o_orderdate))::BIGINT AS date, epoch(date_trunc('day', o_orderdate))::BIGINT AS mdate, epoch(date_trunc('day', o_orderdate))::BIGINT + CASE WHEN year(o_orderdate) < 2000 THEN epoch(date_trunc('day', o_orderdate + INTERVAL 100 YEAR))::BIGINT - epoch(date_trunc('day', o_orderdate))::BIGINT ELSE 0 END AS cmdate, epoch(date_trunc('day', o_orderdate))::BIGINT AS dt, epoch(date_trunc('day', o_orderdate))::BIGINT AS mdt FROM orders")
def date_parse(spark, d):
    """The five ways in which date columns are written, read back as seconds. Two-digit years are of this century."""
    from tallyforge.sources.text_formats import DATE_FORMATS, Field, typed

    o = table(spark, d, "orders")
    day = F.date_trunc("day", F.col("o_orderdate").cast("timestamp"))
    return o.select(F.col("o_orderkey").alias("k"), *[F.unix_timestamp(typed(F.date_format(day, f), Field(kind, "x")).cast("timestamp")).alias(kind) for kind, f in DATE_FORMATS.items()])


@query("batch_gating", f"WITH {SAMPLES}, b AS (SELECT (row_number() OVER (ORDER BY id) - 1) // 300 + 1 AS b FROM smp) SELECT b AS batch, (b - 1) % 11 = 0 AS scored, count(*) AS n FROM b GROUP BY ALL")
def batch_gating(spark, d):
    from tallyforge.operators.transform import batches

    b = batches(samples(spark, d), ("id",), 300).select((F.col("batch_id") + 1).alias("batch"))
    return b.select("batch", E.held_out(F.col("batch"), 11).alias("scored")).groupBy("batch", "scored").agg(F.count("*").alias("n"))
