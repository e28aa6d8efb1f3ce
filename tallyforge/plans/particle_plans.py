"""Pairs of particles, record files of named features, binary matrices and next-word networks over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import collide as C
from tallyforge.plans.catalog import query
from tallyforge.plans.fixtures import TOKENS, dense, table, token_lists
from tallyforge.plans.linear_plans import _uni
from tallyforge.plans.model_plans import MODEL, model
from tallyforge.scratch import scratch


def _normal(number: int) -> str:
    return f"(sqrt(-2 * ln({_uni('key', str(2 * number))})) * cos(2 * pi() * {_uni('key', str(2 * number + 1))}))"


_SUMS = "sum({p} * {p}) AS pp, sum({q} * {q}) AS qq, sum({p} * {q}) AS pq, sum({p} * x) AS px, sum({q} * x) AS qx, sum(x * x) AS xx"


def _collision(source: str, p: str, q: str, hardness: str, number: int) -> str:
    """CTEs x, s, k: the table with its draws, the inner products, the coefficients."""
    return f"""x AS (SELECT *, {_normal(number)} AS x FROM {source}), s AS (SELECT {_SUMS.format(p=p, q=q)} FROM x),
k AS (SELECT *, (pq * qx - qq * px) / (pp * qq - pq * pq + 1e-36) AS al, (pq * px - pp * qx) / (pp * qq - pq * pq + 1e-36) AS be, (pq + qq) / (pp + 2 * pq + qq + 1e-36) AS a, (pq + pp) / (pp + 2 * pq + qq + 1e-36) AS b FROM s),
z AS (SELECT al, be, a, b, sqrt((a * a * pp + b * b * qq - 2 * a * b * pq) * (2 * {hardness} - {hardness} * {hardness}) / (xx + al * px + be * qx)) AS z FROM k),
c AS (SELECT x.*, {hardness} * (a * {p} - b * {q}) + z * (x + al * {p} + be * {q}) AS c FROM x, z)"""


@query("up_collide", f"WITH {MODEL}, {_collision('mdl', 'w', 'g', '0.75::DOUBLE', 0)} SELECT key, round(w - c, 6) + 0.0::DOUBLE AS p, round(g + c, 6) + 0.0::DOUBLE AS q FROM c")
def up_collide(spark, d):
    """Two particles after a collision in which each keeps its energy."""
    m = C.collided(model(spark, d).select("key", F.col("w").alias("p"), F.col("g").alias("q")), "p", "q", 0.75)
    return m.select("key", (F.round("p", 6) + 0.0).alias("p"), (F.round("q", 6) + 0.0).alias("q"))


_SIGN = "CASE WHEN (CAST('0x' || substr(md5('sign:1'), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE < 0.5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"


@query(
    "up_collide_together",
    f"""WITH {MODEL}, x AS (SELECT *, {_normal(1)} AS x FROM mdl), m AS (SELECT *, w - 0.25::DOUBLE * (w - g) AS a, g + 0.25::DOUBLE * (w - g) AS b FROM x),
s AS (SELECT 2 * sum(x * x) AS qa, 2 * sum(x * (a - b)) AS qb, sum(a * a) + sum(b * b) - sum(w * w) - sum(g * g) AS qc FROM m),
f AS (SELECT (-qb + {_SIGN} * sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) AS f FROM s)
SELECT key, round(a + f * x, 6) + 0.0::DOUBLE AS p, round(b - f * x, 6) + 0.0::DOUBLE AS q FROM m, f""",
)
def up_collide_together(spark, d):
    """Two particles after a collision in which both together keep their energy."""
    m = C.collided_together(model(spark, d).select("key", F.col("w").alias("p"), F.col("g").alias("q")), "p", "q", 0.5, number=1)
    return m.select("key", (F.round("p", 6) + 0.0).alias("p"), (F.round("q", 6) + 0.0).alias("q"))


_STEP1 = "m0 AS (SELECT key, w, v, -w AS w2, ss - 0.04::DOUBLE AS v2, g FROM mdl), n1 AS (SELECT key, w + 0.9::DOUBLE * v + 0.05::DOUBLE * g AS w, 0.9::DOUBLE * v + 0.05::DOUBLE * g AS v, w2, v2, g FROM m0)"
_STEP2 = "n2 AS (SELECT key, w2 + 0.9::DOUBLE * v2 + 0.05::DOUBLE * g AS w, 0.9::DOUBLE * v2 + 0.05::DOUBLE * g AS v, w AS w2, v AS v2 FROM n1)"


@query(
    "up_collide_steps",
    f"WITH {MODEL}, {_STEP1}, {_STEP2}, {_collision('n2', 'v', 'v2', '1.0::DOUBLE', 2)} SELECT key, round(w2 + 0.05::DOUBLE * (w - w2), 6) + 0.0::DOUBLE AS w, round(v2 + c, 6) + 0.0::DOUBLE AS v, round(w - 0.05::DOUBLE * (w - w2), 6) + 0.0::DOUBLE AS w2, round(v - c, 6) + 0.0::DOUBLE AS v2 FROM c",
)
def up_collide_steps(spark, d):
    """Two steps of a pair of particles: each is trained once, then momenta collide and weights attract."""
    start = model(spark, d).select("key", "w", "v", (-F.col("w")).alias("w2"), (F.col("ss") - 0.04).alias("v2"), "g")
    m = C.pair_step(start, "g", 0.05, 0.9, 1)
    m = C.pair_step(m.join(start.select("key", "g"), "key"), "g", 0.05, 0.9, 2)
    return m.select("key", *[(F.round(c, 6) + 0.0).alias(c) for c in ("w", "v", "w2", "v2")])


# Files -------------------------------------------------------------------------------------------------------------


@query("src_examples", "SELECT c_mktsegment AS segment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, CAST(sum(c_nationkey + len(c_name)) AS BIGINT) AS second, round(sum(CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE)), 2) AS balance FROM customer GROUP BY 1")
def src_examples(spark, d):
    """Customers as records of named features, written by partition and read back: two whole numbers, a float, a name."""
    from tallyforge.sources import examples

    path = scratch(spark, "examples")
    made = {
        "ids": examples.feature(F.array("c_custkey", F.col("c_nationkey") + F.length("c_name")), "ints"),
        "balance": examples.feature(F.array("c_acctbal"), "floats"),
        "segment": examples.feature(F.array(F.encode("c_mktsegment", "utf-8")), "bytes"),
    }
    examples.write_examples(table(spark, d, "customer"), made, path)
    f = F.col("features")
    r = examples.read_examples(spark, path).select(F.decode(f["segment"]["bytes"][0], "utf-8").alias("segment"), f["ids"]["ints"].alias("ids"), f["balance"]["floats"][0].cast("double").alias("balance"))
    return r.groupBy("segment").agg(F.count("*").alias("n"), F.sum(F.col("ids")[0]).alias("keys"), F.sum(F.col("ids")[1]).alias("second"), F.round(F.sum("balance"), 2).alias("balance"))


@query("src_matrix_files", "SELECT l_partkey AS \"row\", l_suppkey AS col, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS value FROM lineitem GROUP BY ALL")
def src_matrix_files(spark, d):
    """Quantities by part and supplier as compressed sparse matrix files of 64 columns each, read back cell by cell."""
    from tallyforge.sources import matrices

    path = scratch(spark, "matrices")
    x = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("value"))
    size = x.agg(F.max("row")).first()[0]
    matrices.write_matrix(x.groupBy("col").agg(F.collect_list(F.struct("row", "value")).alias("cells")), (size or 0) + 1, path, 64, kind=4, compressed=True)
    return matrices.read_matrix(spark, path, 64)


# Next words --------------------------------------------------------------------------------------------------------


def _cell(n: int, word: str) -> str:
    """CTE n of a chain of cells with one coordinate: new cell value c and output h from a word's number."""
    z = lambda a, b, c: f"1 / (1 + exp(-({a}::DOUBLE * 0.1::DOUBLE * ({word} - 2) + {b}::DOUBLE * h + {c}::DOUBLE)))"
    new = f"{z(-0.4, 0.2, 0.2)} * c + {z(0.5, 0.3, 0.1)} * tanh(0.7::DOUBLE * 0.1::DOUBLE * ({word} - 2) + 0.25::DOUBLE * h)"
    return f"a{n} AS (SELECT *, {new} AS nc, {z(0.6, -0.1, -0.1)} AS no FROM s{n - 1}), s{n} AS (SELECT * EXCLUDE (c, h, nc, no, ll), nc AS c, no * tanh(nc) AS h, ll + {_LIKELY.format(h='(no * tanh(nc))', t=f'w{n}')} AS ll FROM a{n})"


_LIKELY = "(0.3::DOUBLE * ({t} - 1) * {h} + 0.1::DOUBLE * {t} - ln(" + " + ".join(f"exp({0.3 * (k - 1):.1f}::DOUBLE * {{h}} + {0.1 * k:.1f}::DOUBLE)" for k in range(5)) + "))"
_RUNS = "SELECT pos, len(tok) % 5 AS w0, " + ", ".join(f"lead(len(tok) % 5, {k}) OVER (PARTITION BY doc_id ORDER BY pos) AS w{k}" for k in (1, 2, 3)) + " FROM tok"


@query("next_word", f"WITH {TOKENS}, r AS ({_RUNS}), s0 AS (SELECT w0, w1, w2, w3, 0.0::DOUBLE AS c, 0.0::DOUBLE AS h, 0.0::DOUBLE AS ll FROM r WHERE pos % 3 = 0 AND w3 IS NOT NULL), {_cell(1, 'w0')}, {_cell(2, 'w1')}, {_cell(3, 'w2')} SELECT count(*) AS windows, round(sum(ll) / (3 * count(*)), 7) AS ll FROM s3")
def next_word(spark, d):
    """How well a chain of three cells with given weights foretells next words, a word being its length modulo 5."""
    import numpy as np

    from tallyforge.operators import language as N

    k = np.arange(5.0)
    w = {
        "in": 0.1 * (k - 2)[:, None], "out": 0.3 * (k - 1)[:, None], "out_bias": 0.1 * k,
        "gates0": np.array([[0.5, 0.3], [-0.4, 0.2], [0.6, -0.1], [0.7, 0.25]]), "bias0": np.array([0.1, 0.2, -0.1, 0.0]),
    }
    lists = token_lists(spark, d).select(F.transform("toks", lambda t: (F.length(t) % 5).cast("string")).alias("toks"))
    n, ll = N.score(N.windows(lists, "toks", ["0", "1", "2", "3", "4"], 3), w)
    return spark.createDataFrame([(n, round(ll, 7))], "windows bigint, ll double")


@query("next_word_fit", f"WITH {TOKENS}, n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1) SELECT CAST(sum((n - 1) // 8) AS BIGINT) AS windows, TRUE AS better FROM n")
def next_word_fit(spark, d):
    """Two levels, trained for three steps over all windows of eight words: next words become likelier than at the start."""
    from tallyforge.operators import language as N
    from tallyforge.operators import text as T
    from tallyforge.plans.fixtures import tokens
    from tallyforge.scratch import kept

    common = [r["tok"] for r in T.ranked(T.dictionary(tokens(spark, d))).where("rank < 63").orderBy("rank").collect()]  # the model's word list
    runs = kept(N.windows(token_lists(spark, d), "toks", common, 8), "windows")
    w = N.start(len(common) + 1, 4, 2)
    n, before = N.score(runs, w)
    return spark.createDataFrame([(n, N.score(runs, N.train(runs, w, 3, 0.1))[1] > before)], "windows bigint, better boolean")
