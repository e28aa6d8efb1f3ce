"""Factor models, decompositions, embeddings and sequence models over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import special as S
from tallyforge.functions.arrays import dot
from tallyforge.operators import decompose as D
from tallyforge.operators import factor as X
from tallyforge.operators import text as T
from tallyforge.plans import linear_plans
from tallyforge.plans.catalog import query
from tallyforge.scratch import kept
from tallyforge.plans.fixtures import RATINGS, SAMPLES, TOKENS, counts, dense, ratings, table, token_lists, tokens

TRI = f"{TOKENS}, tri AS (SELECT doc_id AS doc, tok AS term, CAST(count(*) AS DOUBLE) AS s FROM tok GROUP BY ALL), mdl AS (SELECT term, 0.1::DOUBLE * (1 + len(term) % 3) AS m1, 0.1::DOUBLE * (1 + len(term) % 4) AS m2 FROM (SELECT DISTINCT term FROM tri))"


def triples(spark, d):
    """(doc, term, s), counted from the texts once and kept: every step reads the table."""
    return kept(counts(spark, d).select(F.col("doc_id").alias("doc"), F.col("tok").alias("term"), F.col("cnt").cast("double").alias("s")), "triples")


def topic_model(t):
    n = F.length("term")
    return t.select("term").distinct().select("term", F.array(0.1 * (1 + n % 3), 0.1 * (1 + n % 4)).alias("m"))


_USER = """u1 AS (SELECT doc, sum(s / (m1 + m2) * m1) + 0.01::DOUBLE AS a, sum(s / (m1 + m2) * m2) + 0.01::DOUBLE AS b FROM tri JOIN mdl USING (term) GROUP BY doc)"""


@query("lda_vb", f"WITH {TRI}, {_USER}, u2 AS (SELECT doc, max(a) * sum(s / (a * m1 + b * m2) * m1) + 0.01::DOUBLE AS a, max(b) * sum(s / (a * m1 + b * m2) * m2) + 0.01::DOUBLE AS b FROM tri JOIN mdl USING (term) JOIN u1 USING (doc) GROUP BY doc) SELECT doc, round(a, 4) AS a, round(b, 4) AS b FROM u2")
def lda_vb(spark, d):
    t = triples(spark, d)
    m, u = topic_model(t), X.start_users(t, 2)
    for _ in range(2):
        u = X.lda_user_step(t, u, m, 2, 0.01)
    return u.select("doc", F.round(F.get("u", F.lit(0)), 4).alias("a"), F.round(F.get("u", F.lit(1)), 4).alias("b"))


@query("lda_model", f"WITH {TRI}, {_USER} SELECT term, round(max(m1) * sum(s / (a * m1 + b * m2) * a) + 0.001::DOUBLE, 5) AS m1, round(max(m2) * sum(s / (a * m1 + b * m2) * b) + 0.001::DOUBLE, 5) AS m2 FROM tri JOIN mdl USING (term) JOIN u1 USING (doc) GROUP BY term")
def lda_model(spark, d):
    t = triples(spark, d)
    m = topic_model(t)
    u = X.lda_user_step(t, X.start_users(t, 2), m, 2, 0.01)
    n = X.lda_model_step(t, u, m, 2, 0.001)
    return n.select("term", F.round(F.get("m", F.lit(0)), 5).alias("m1"), F.round(F.get("m", F.lit(1)), 5).alias("m2"))


@query("lda_loglik", f"WITH {TRI}, {_USER}, z AS (SELECT sum(m1) AS z1, sum(m2) AS z2 FROM mdl) SELECT round(sum(s * ln(a / (a + b) * m1 / z1 + b / (a + b) * m2 / z2)) / sum(s), 5) AS ll FROM tri JOIN mdl USING (term) JOIN u1 USING (doc), z")
def lda_loglik(spark, d):
    t = triples(spark, d)
    m = topic_model(t)
    return X.lda_loglik(t, X.lda_user_step(t, X.start_users(t, 2), m, 2, 0.01), m, 2).select(F.round("ll", 5).alias("ll"))


_EXPPSI = lambda x: f"exp((lgamma({x} + 1e-4) - lgamma({x} - 1e-4)) / 2e-4)"


@query("lda_exppsi", f"WITH {TRI}, {_USER} SELECT doc, round({_EXPPSI('a')}, 2) AS a, round({_EXPPSI('b')}, 2) AS b FROM u1")
def lda_exppsi(spark, d):
    t = triples(spark, d)
    u = X.lda_user_step(t, X.start_users(t, 2), topic_model(t), 2, 0.01, expectation=lambda x: S.exp_digamma(x))
    return u.select("doc", F.round(F.get("u", F.lit(0)), 2).alias("a"), F.round(F.get("u", F.lit(1)), 2).alias("b"))


_KNOWN = f"{TOKENS}, kn AS (SELECT tok, count(DISTINCT doc_id) AS df FROM tok GROUP BY tok HAVING count(DISTINCT doc_id) >= 5)"


@query("lda_fit", f"WITH {_KNOWN} SELECT CAST(t AS INTEGER) AS topic, (SELECT count(*) FROM kn) AS terms, 1.0::DOUBLE AS total, TRUE AS positive FROM range(0, 3) g(t)")
def lda_fit(spark, d):
    """Topics of the library's variational model over all words of five texts or more: each topic's weights, brought to
    sum one, are positive over the whole vocabulary."""
    topics = lda_topics(spark, d)
    return topics.groupBy("topic").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("total"), F.min(F.col("weight") > 0).alias("positive"))


def lda_topics(spark, d):
    """(topic, term, weight) of a fitted model."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    words = token_lists(spark, d).withColumnRenamed("toks", "words")
    vocabulary = CountVectorizer(inputCol="words", outputCol="features", vocabSize=1 << 20, minDF=5).fit(words)
    model = LDA(k=3, maxIter=2, seed=1).fit(vocabulary.transform(words))
    rows = model.describeTopics(len(vocabulary.vocabulary)).select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("z"))
    return rows.select("topic", F.col("z.termIndices").alias("term"), F.col("z.termWeights").alias("weight"))


_KEY = "doc * 7919 + ascii(term) * 131 + len(term) * 17"
_P1 = lambda power: f"pow(m1, {power}) / (pow(m1, {power}) + pow(m2, {power}))"


def _gibbs_sql(samples: str, power: float) -> str:
    draw = linear_plans._uni("k", "i")
    return f"WITH {TRI}, c AS (SELECT doc, {_KEY} AS k, {_P1(power)} AS p1, CAST(s AS BIGINT) * {samples} AS s FROM tri JOIN mdl USING (term)), n AS (SELECT doc, s, len(list_filter(range(0, s), lambda i: {draw} <= p1)) AS n1 FROM c) SELECT doc, CAST(sum(n1) AS BIGINT) AS n1, CAST(sum(s - n1) AS BIGINT) AS n2 FROM n GROUP BY doc"


def _gibbs(spark, d, samples=None, cooling=1.0):
    t = triples(spark, d)
    n = X.gibbs_counts(t, X.start_users(t, 2), topic_model(t), 2, samples, cooling)
    return n.select("doc", F.get("n", F.lit(0)).alias("n1"), F.get("n", F.lit(1)).alias("n2"))


@query("lda_gibbs", _gibbs_sql("1", 0.5))
def lda_gibbs(spark, d):
    """Topic counts by sampling, cooled to half: a topic for each token, drawn from the current factors."""
    return _gibbs(spark, d, cooling=2.0)


@query("lda_gibbs_v", _gibbs_sql("(1 + len(term) % 3)", 1.0))
def lda_gibbs_v(spark, d):
    """The same with a number of samples for each feature."""
    return _gibbs(spark, d, samples=F.lit(1) + F.length("term") % 3)


@query("nmf", f"WITH {TRI}, g AS (SELECT sum(m1 * m1) AS g11, sum(m1 * m2) AS g12, sum(m2 * m2) AS g22 FROM mdl), p AS (SELECT doc, sum(s * m1) AS p1, sum(s * m2) AS p2 FROM tri JOIN mdl USING (term) GROUP BY doc) SELECT doc, round(greatest(0.1, least(10.0, p1 / (g11 + 0.01 + g12))), 5) AS a, round(greatest(0.1, least(10.0, p2 / (g12 + g22 + 0.01))), 5) AS b FROM p, g")
def nmf(spark, d):
    t = triples(spark, d)
    m = topic_model(t)
    _, _, g = D.moments(m, "m", 2)
    u = X.nmf_user_step(t, X.start_users(t, 2), m, g.tolist(), 0.01)
    return u.select("doc", F.round(F.get("u", F.lit(0)), 5).alias("a"), F.round(F.get("u", F.lit(1)), 5).alias("b"))


@query(
    "click",
    f"""WITH {RATINGS}, v AS (SELECT "user" AS doc, item AS term, CAST(rating AS DOUBLE) AS v, rating // 10 AS c FROM rat WHERE rating > 10),
x AS (SELECT c, greatest(v * (0.1::DOUBLE * (1 + doc % 3) * 0.2::DOUBLE * (1 + term % 2) + 0.05::DOUBLE), 1e-10) AS r FROM v)
SELECT round(avg(CASE WHEN c >= 2 THEN c ELSE 0 END * ln(r) - r), 5) AS score FROM x""",
)
def click(spark, d):
    r = ratings(spark, d).where("rating > 10")
    views = r.select(F.col("user").alias("doc"), F.col("item").alias("term"), F.col("rating").cast("double").alias("v"))
    clicks = r.select(F.col("user").alias("doc"), F.col("item").alias("term"), F.floor(F.col("rating") / 10).alias("c")).where("c >= 2")
    u = views.select("doc").distinct().select("doc", F.array(0.1 * (1 + F.col("doc") % 3), F.lit(0.05)).alias("u"))
    m = views.select("term").distinct().select("term", F.array(0.2 * (1 + F.col("term") % 2), F.lit(1.0)).alias("m"))
    return X.poisson_score(views, clicks, u, m).select(F.round("score", 5).alias("score"))


@query("sfa_baseline", f'WITH {RATINGS}, m AS (SELECT avg(rating) AS m FROM rat), i AS (SELECT item, sum(rating - m) / (count(*) + 5) AS io FROM rat, m GROUP BY item), u AS (SELECT "user", sum(rating - m - io) / (count(*) + 5) AS uo FROM rat JOIN i USING (item), m GROUP BY "user") SELECT round(sqrt(avg((rating - m - io - uo) * (rating - m - io - uo))), 6) AS rmse FROM rat JOIN i USING (item) JOIN u USING ("user"), m')
def sfa_baseline(spark, d):
    from tallyforge.operators.evaluate import rmse

    b = X.baselines(ratings(spark, d), 5.0)
    return b.agg(F.round(rmse(F.col("rating"), F.col("mean") + F.col("item_off") + F.col("user_off")), 6).alias("rmse"))


@query("sfa_fit", None)
def sfa_fit(spark, d):
    from pyspark.ml.recommendation import ALS

    r = ratings(spark, d).select(F.col("user").cast("int"), F.col("item").cast("int"), F.col("rating").cast("float"))
    m = ALS(rank=4, maxIter=2, regParam=0.5, userCol="user", itemCol="item", ratingCol="rating", seed=1, coldStartStrategy="drop").fit(r)
    return m.transform(r).agg(F.round(F.sqrt(F.avg(F.pow(F.col("rating") - F.col("prediction"), 2))), 3).alias("rmse"))


_UN = linear_plans._uni
_Z = lambda n: f"(sqrt(-2 * ln({_UN('u.\"user\"', str(2 * n))})) * cos(2 * pi() * {_UN('u.\"user\"', str(2 * n + 1))}))"


@query(
    "smf_langevin",
    f"""WITH {RATINGS}, j AS (SELECT "user", CAST(rating AS DOUBLE) AS y, (1 + item % 3) / 5.0::DOUBLE AS m1, (1 + item % 5) / 5.0::DOUBLE AS m2 FROM rat),
g AS (SELECT "user", avg((y - 5 * m1 - 5 * m2) * m1) AS g1, avg((y - 5 * m1 - 5 * m2) * m2) AS g2 FROM j GROUP BY 1),
v AS (SELECT u."user", 5 + 0.02::DOUBLE * g1 + 0.05::DOUBLE * {_Z(0)} AS v1, 5 + 0.02::DOUBLE * g2 + 0.05::DOUBLE * {_Z(1)} AS v2, ln({_UN('u."user"', '5')}) AS draw FROM g u),
l AS (SELECT "user", any_value(v1) AS v1, any_value(v2) AS v2, any_value(draw) AS draw, avg((y - 5 * m1 - 5 * m2) * (y - 5 * m1 - 5 * m2)) AS old, avg((y - v1 * m1 - v2 * m2) * (y - v1 * m1 - v2 * m2)) AS new FROM j JOIN v USING ("user") GROUP BY 1)
SELECT "user", draw < old - new AS kept, round(CASE WHEN draw < old - new THEN v1 ELSE 5 END, 6) AS u1, round(CASE WHEN draw < old - new THEN v2 ELSE 5 END, 6) AS u2, round(CASE WHEN draw < old - new THEN new ELSE old END, 4) AS loss FROM l""",
)
def smf_langevin(spark, d):
    """One accept-or-reject step of every user's factors against given item factors; draws come from the user's key."""
    r = ratings(spark, d).select("user", "item", F.col("rating").cast("double").alias("y"))
    items = r.select("item").distinct().select("item", F.array((1 + F.col("item") % 3) / 5.0, (1 + F.col("item") % 5) / 5.0).alias("m"))
    users = r.select("user").distinct().select("user", F.array(F.lit(5.0), F.lit(5.0)).alias("u"))
    s = X.langevin_step(r, users, items, "user", 2, 0.01, 0.05)
    return s.select("user", "kept", F.round(F.get("u", F.lit(0)), 6).alias("u1"), F.round(F.get("u", F.lit(1)), 6).alias("u2"), F.round("loss", 4).alias("loss"))


@query(
    "mhtest",
    f"""WITH {SAMPLES}, p AS (SELECT ln(CASE WHEN y = 1 THEN 1 / (1 + exp(-0.5 * f1)) ELSE 1 - 1 / (1 + exp(-0.5 * f1)) END) - ln(CASE WHEN y = 1 THEN 1 / (1 + exp(-0.4 * f1)) ELSE 1 - 1 / (1 + exp(-0.4 * f1)) END) AS v FROM smp WHERE id % 10 = 3),
a AS (SELECT sum(v) * 10 AS delta, 10 * stddev_samp(v) * sqrt(count(*)) AS error, count(*) AS n FROM p), u AS (SELECT *, {_UN('n', '0')} AS u FROM a)
SELECT round(delta, 4) AS delta, round(error, 4) AS error, round(ln(u / (1 - u)), 5) AS draw, error < 1 AS decided, delta + ln(u / (1 - u)) > 0 AS accept FROM u""",
)
def mhtest(spark, d):
    """A minibatch acceptance test: the whole data's log-likelihood difference as a tenth of the samples estimates it, the
    estimate's error, and acceptance by a logistic draw. If the error is over one the batch is too small to decide."""
    from tallyforge.functions import sampling
    from tallyforge.plans.fixtures import samples

    s = samples(spark, d).where("id % 10 = 3")
    ll = lambda w: F.ln(F.when(F.col("y") == 1, S.logistic(F.col("f1") * w)).otherwise(1 - S.logistic(F.col("f1") * w)))
    a = s.agg((F.sum(ll(0.5) - ll(0.4)) * 10).alias("delta"), (10 * F.stddev_samp(ll(0.5) - ll(0.4)) * F.sqrt(F.count("*"))).alias("error"), F.count("*").alias("n"))
    u = sampling.uniform(F.col("n"))
    draw = F.ln(u / (1 - u))
    return a.select(F.round("delta", 4).alias("delta"), F.round("error", 4).alias("error"), F.round(draw, 5).alias("draw"), (F.col("error") < 1).alias("decided"), (F.col("delta") + draw > 0).alias("accept"))


@query("svd_values", None)
def svd_values(spark, d):
    values, _ = D.svd(dense(spark, d, 1, 8), "x", 8, 3)
    return spark.createDataFrame([(i, round(float(v), 4)) for i, v in enumerate(values)], "i int, value double")


@query("svd_energy", "WITH e AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT round(sum(v), 4) AS energy FROM (SELECT var_pop(x) * count(*) AS v FROM e WHERE i <= 8 GROUP BY i)")
def svd_energy(spark, d):
    """All squared singular values of centred data add up to its spread."""
    values, _ = D.svd(dense(spark, d, 1, 8), "x", 8, 8, passes=5)
    return spark.createDataFrame([(round(float((values**2).sum()), 4),)], "energy double")


@query("ica", None)
def ica(spark, d):
    w = D.ica(dense(spark, d, 1, 8), "x", 8, 3)
    return spark.createDataFrame([(i, j, round(float(w[i, j]), 4)) for i in range(3) for j in range(8)], "i int, j int, w double")


@query("ica_moments", "WITH e AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT i, round(avg(tanh(x)), 6) AS logcosh, round(avg(x * exp(-x * x / 2)), 6) AS exponent, round(avg(x * x * x), 6) AS kurtosis, round(avg(ln(cosh(x))), 6) AS negentropy FROM e WHERE i <= 8 GROUP BY i")
def ica_moments(spark, d):
    x = dense(spark, d, 1, 8).select(F.posexplode("x").alias("i", "x"))
    cols = [F.round(F.avg(g(F.col("x"))), 6).alias(n) for n, (g, _) in D.CONTRASTS.items()]
    return x.groupBy((F.col("i") + 1).alias("i")).agg(*cols, F.round(F.avg(S.log_cosh(F.col("x"))), 6).alias("negentropy"))


@query("up_cg", "SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS i, 0.0::DOUBLE AS residual")
def up_cg(spark, d):
    """Ridge weights by conjugate gradient on moments that Spark sums: what is left of the normal equations, summed anew
    over the rows, is zero."""
    import numpy as np

    e = dense(spark, d, 1, 8)
    _, _, g = D.moments(e, "x", 8)
    b = e.agg(*[F.sum(F.get("x", F.lit(i)) * F.col("label")).alias(f"b{i}") for i in range(8)]).first()
    w = D.conjugate_gradient(g + np.eye(8), np.array(list(b)), diagonal=np.diag(g) + 1)
    left = F.col("label") - dot(F.col("x"), F.array(*[F.lit(float(v)) for v in w]))
    r = e.agg(F.array(*[F.sum(F.get("x", F.lit(i)) * left) - float(w[i]) for i in range(8)]).alias("r"))
    return r.select(F.posexplode("r").alias("i", "v")).select("i", (F.round("v", 4) + 0.0).alias("residual"))


# Embeddings and sequences ------------------------------------------------------------------------------------------


@query("word2vec_fit", f"WITH {TOKENS} SELECT tok AS word, 8 AS size, TRUE AS finite FROM tok GROUP BY tok HAVING count(*) >= 10")
def word2vec_fit(spark, d):
    """The library's vectors of all words seen ten times or more: a finite one of eight numbers for each."""
    v = word_vectors(spark, d)
    return v.select("word", F.size("v").alias("size"), F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < 1e6)).alias("finite"))


def word_vectors(spark, d):
    """(word, v) of a fitted skip-gram model."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    words = token_lists(spark, d).withColumnRenamed("toks", "words")
    m = Word2Vec(vectorSize=8, minCount=10, maxIter=1, seed=1, inputCol="words", outputCol="v", numPartitions=4).fit(words)
    return m.getVectors().select("word", vector_to_array("vector").alias("v"))


@query("word2vec_negatives", f"WITH {TOKENS}, c AS (SELECT tok, count(*) AS cnt FROM tok GROUP BY tok) SELECT tok, round(pow(cnt, 0.75) / sum(pow(cnt, 0.75)) OVER (), 10) AS p, round(least(1.0, sqrt(0.001 * sum(cnt) OVER () / cnt) + 0.001 * sum(cnt) OVER () / cnt), 8) AS keep FROM c")
def word2vec_negatives(spark, d):
    """How likely a token is drawn as a negative, and how likely a frequent one is kept."""
    c = T.dictionary(tokens(spark, d))
    t = c.agg(F.sum(F.pow("cnt", F.lit(0.75))).alias("z"), F.sum("cnt").alias("n"))
    r = 0.001 * F.col("n") / F.col("cnt")
    return c.crossJoin(F.broadcast(t)).select("tok", F.round(F.pow("cnt", F.lit(0.75)) / F.col("z"), 10).alias("p"), F.round(F.least(F.lit(1.0), F.sqrt(r) + r), 8).alias("keep"))


@query("word2vec_score", "WITH e AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), p AS (SELECT a.vec_id AS a, sum(a.x * b.x) AS s FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY 1) SELECT round(avg(ln(1 / (1 + exp(-s)))), 6) AS score FROM p")
def word2vec_score(spark, d):
    e = dense(spark, d, 1, 64)
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return e.join(n, "vec_id").agg(F.round(F.avg(F.ln(S.guarded_logistic(dot(F.col("x"), F.col("y"))))), 6).alias("score"))


@query("word2vec_hier", None)
def word2vec_hier(spark, d):
    """Codes of a Huffman tree over the words seen ten times or more: the tree is the model and is held by the driver."""
    from tallyforge.operators.huffman import codes

    rows = [(r["tok"], r["cnt"]) for r in T.trim(T.dictionary(tokens(spark, d)), 10).orderBy(F.desc("cnt"), "tok").collect()]
    return spark.createDataFrame([(w, c, len(c)) for w, c in codes(rows)], "tok string, code string, depth int")


@query("transformer_positions", "SELECT CAST(p AS INTEGER) AS pos, CAST(i AS INTEGER) AS dim, round(CASE WHEN i % 2 = 0 THEN sin(p / pow(10000, (i - i % 2) / 16.0)) ELSE cos(p / pow(10000, (i - i % 2) / 16.0)) END, 8) AS v FROM range(0, 64) a(p), range(0, 16) b(i)")
def transformer_positions(spark, d):
    grid = spark.range(64).select(F.col("id").cast("int").alias("pos")).withColumn("dim", F.explode(F.sequence(F.lit(0), F.lit(15))))
    angle = F.col("pos") / F.pow(F.lit(10000.0), (F.col("dim") - F.col("dim") % 2) / 16.0)
    return grid.select("pos", "dim", F.round(F.when(F.col("dim") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)), 8).alias("v"))


@query("transformer_mask", "SELECT CAST(q AS INTEGER) AS q, CAST(k AS INTEGER) AS k FROM range(0, 64) a(q), range(0, 64) b(k) WHERE k <= q AND (q - k < 8 OR (q - k) % 8 = 0)")
def transformer_mask(spark, d):
    """Keys that a query may see: its near past, and every eighth further back."""
    q = spark.range(64).select(F.col("id").cast("int").alias("q")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("q"))))
    return q.where("q - k < 8 or (q - k) % 8 = 0")


@query("attention", "WITH e AS (SELECT vec_id // 8 AS seq, vec_id, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), s AS (SELECT a.vec_id AS q, b.vec_id AS k, sum(a.x * b.x) / 2.0 AS s FROM e a JOIN e b ON a.seq = b.seq AND a.i = b.i WHERE a.i <= 4 AND b.vec_id <= a.vec_id GROUP BY ALL), w AS (SELECT q, k, exp(s) / sum(exp(s)) OVER (PARTITION BY q) AS w FROM s) SELECT q, round(sum(w * x), 6) AS y FROM w JOIN e ON e.vec_id = k WHERE e.i = 5 GROUP BY q")
def attention(spark, d):
    """Causal attention of sequences of eight: queries and keys are coordinates 1 to 4, the value is coordinate 5."""
    e = dense(spark, d, 1, 5).select(F.floor(F.col("vec_id") / 8).alias("seq"), "vec_id", F.slice("x", 1, 4).alias("h"), F.get("x", F.lit(4)).alias("v"))
    keys = e.groupBy("seq").agg(F.collect_list(F.struct("vec_id", "h", "v")).alias("ks"))  # a sequence's eight rows
    j = e.join(keys, "seq").select(F.col("vec_id").alias("q"), "h", F.filter("ks", lambda k: k["vec_id"] <= F.col("vec_id")).alias("ks"))
    w = F.transform("ks", lambda k: F.struct(F.exp(dot(F.col("h"), k["h"]) / 2.0).alias("w"), k["v"].alias("v")))
    j = j.select("q", w.alias("w"))
    z = F.aggregate("w", F.lit(0.0), lambda a, x: a + x["w"])
    return j.select("q", F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x["w"] * x["v"]) / z, 6).alias("y"))


@query("seq2seq_oov", f"WITH {TOKENS}, dic AS (SELECT tok, row_number() OVER (ORDER BY count(*) DESC, tok) - 1 AS rank FROM tok GROUP BY tok) SELECT doc_id, pos, CASE WHEN rank < 1000 THEN rank ELSE 1000 END AS id FROM tok JOIN dic USING (tok)")
def seq2seq_oov(spark, d):
    t = tokens(spark, d)
    known = T.ranked(T.dictionary(t)).where("rank < 1000")
    return T.map_ids(t, F.broadcast(known), 1000).select("doc_id", "pos", "id")


@query("attention_heads", " UNION ALL ".join(f"(WITH e AS (SELECT vec_id // 8 AS seq, vec_id, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), s AS (SELECT a.vec_id AS q, b.vec_id AS k, sum(a.x * b.x) / sqrt(2.0::DOUBLE) AS s FROM e a JOIN e b ON a.seq = b.seq AND a.i = b.i WHERE a.i IN ({2 * h + 1}, {2 * h + 2}) AND b.vec_id <= a.vec_id GROUP BY ALL), w AS (SELECT q, k, exp(s) / sum(exp(s)) OVER (PARTITION BY q) AS w FROM s) SELECT q, {h} AS head, round(sum(w * x), 6) + 0.0::DOUBLE AS y FROM w JOIN e ON e.vec_id = k WHERE e.i = {7 + h} GROUP BY q)" for h in range(3)))
def attention_heads(spark, d):
    """Causal attention of sequences of eight with three heads of two coordinates; head h's value is coordinate 7 + h."""
    e = dense(spark, d, 1, 9).select(F.floor(F.col("vec_id") / 8).alias("seq"), "vec_id", "x")
    keys = e.groupBy("seq").agg(F.collect_list(F.struct("vec_id", "x")).alias("ks"))  # a sequence's eight rows
    j = e.join(keys, "seq").select(F.col("vec_id").alias("q"), "x", F.filter("ks", lambda k: k["vec_id"] <= F.col("vec_id")).alias("ks"))

    def head(h):
        own = F.slice("x", 2 * h + 1, 2)
        w = F.transform("ks", lambda k: F.struct(F.exp(dot(own, F.slice(k["x"], 2 * h + 1, 2)) / F.sqrt(F.lit(2.0))).alias("w"), F.get(k["x"], F.lit(6 + h)).alias("v")))
        z = F.aggregate(w, F.lit(0.0), lambda a, x: a + x["w"])
        return F.struct(F.lit(h).alias("head"), (F.round(F.aggregate(w, F.lit(0.0), lambda a, x: a + x["w"] * x["v"]) / z, 6) + 0.0).alias("y"))

    return j.select("q", F.explode(F.array(*[head(h) for h in range(3)])).alias("z")).select("q", "z.*")


@query("next_word_pairs", f"WITH {TOKENS}, p AS (SELECT tok AS word, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM tok), c AS (SELECT word, nxt, count(*) AS n FROM p WHERE nxt IS NOT NULL GROUP BY ALL) SELECT word, nxt, n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, nxt) AS k FROM c) WHERE k = 1")
def next_word_pairs(spark, d):
    """The commonest next word of each word."""
    p = T.ngram_counts(token_lists(spark, d), 2).select(F.col("w1").alias("word"), F.col("w2").alias("nxt"), F.col("cnt").alias("n"))
    return p.groupBy("word").agg(F.min_by(F.struct("nxt", "n"), F.struct(-F.col("n"), F.col("nxt"))).alias("b")).select("word", "b.nxt", "b.n")


@query("hamming_dists", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(bit_count(xor(a.n_nationkey * 2654435761, b.n_nationkey * 2654435761)) AS INTEGER) AS dist FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey")
def hamming_dists(spark, d):
    n = table(spark, d, "nation")
    a = n.select(F.col("n_nationkey").cast("long").alias("a"))
    b = n.select(F.col("n_nationkey").cast("long").alias("b"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select(F.col("a").cast("int"), F.col("b").cast("int"), F.bit_count((F.col("a") * 2654435761).bitwiseXOR(F.col("b") * 2654435761)).alias("dist"))


