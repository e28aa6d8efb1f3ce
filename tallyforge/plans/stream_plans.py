"""Minibatch streams, replicas and model exchange over the tables."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from tallyforge.operators import allreduce as R
from tallyforge.plans.catalog import query
from tallyforge.plans.fixtures import SAMPLES, samples, table
from tallyforge.plans.model_plans import LINES, VOTES_A, VOTES_B
from tallyforge.scratch import scratch
from tallyforge.streaming.passes import RunningSums, StreamingPass, table_stream


@query("st_minibatch", "SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1")
def st_minibatch(spark, d):
    """A pass over a stream: partial sums of each micro-batch, added up."""
    base = scratch(spark, "stream")
    sums = RunningSums(f"{base}/sums")
    part = lambda b: b.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    StreamingPass(table_stream(spark, d, "events"), sums.fold(part), f"{base}/checkpoint").finish()
    return sums.read(spark).groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))


def _stream_sql(n: int) -> str:
    g = [f"avg((y - 1 / (1 + exp(-(any0 * f1 + any1)))) * {x})" for x in ("f1", "1.0::DOUBLE")]
    return f"b{n} AS (SELECT y, f1, w0 AS any0, w1 AS any1 FROM smp, m{n - 1} WHERE id % 3 = {n - 1}), m{n} AS (SELECT any_value(any0) + 0.5::DOUBLE * {g[0]} AS w0, any_value(any1) + 0.5::DOUBLE * {g[1]} AS w1 FROM b{n})"


@query("st_train", f"WITH {SAMPLES}, m0 AS (SELECT 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1), {_stream_sql(1)}, {_stream_sql(2)}, {_stream_sql(3)} SELECT round(w0, 6) AS w0, round(w1, 6) AS w1 FROM m3")
def st_train(spark, d):
    """A logistic model learns from three micro-batches in turn, one gradient step each."""
    from tallyforge.functions.special import logistic
    from tallyforge.streaming.passes import StreamingTrainer

    base = scratch(spark, "train")
    s = samples(spark, d).select("id", "f1", "y", (F.col("id") % 3).alias("b"))
    for b in range(3):  # one file a batch; a stream takes the older file first
        s.where(F.col("b") == b).drop("b").coalesce(1).write.mode("append").parquet(f"{base}/in")
        time.sleep(0.05)

    def step(w, batch, number):
        slope = F.col("y") - logistic(F.lit(w[0]) * F.col("f1") + F.lit(w[1]))
        g = batch.agg(F.avg(slope * F.col("f1")).alias("a"), F.avg(slope).alias("b")).first()
        return [w[0] + 0.5 * g["a"], w[1] + 0.5 * g["b"]]

    stream = spark.readStream.schema("id long, f1 double, y int").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    w = StreamingTrainer(spark, f"{base}/models", [0.0, 0.0], step).run(stream)
    return spark.createDataFrame([(round(w[0], 6), round(w[1], 6))], "w0 double, w1 double")


@query("st_iterator_pass", "SELECT count(*) AS n, round(sum(value), 2) AS s FROM events")
def st_iterator_pass(spark, d):
    """A pass that is fed by iterators of blocks, one result a partition, summed."""

    def run(parts):
        import pandas as pd

        n, s = 0, 0.0
        for pdf in parts:
            n, s = n + len(pdf), s + float(pdf["value"].sum())
        yield pd.DataFrame({"n": [n], "s": [s]})

    return table(spark, d, "events").select("value").mapInPandas(run, "n long, s double").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("s"))


_G = "avg((y - 1 / (1 + exp(-0.1 * f1))) * f1)"


@query("st_parlearner", f"WITH {SAMPLES}, r AS (SELECT id % 4 AS replica, 0.1 + 0.5 * {_G} AS w, count(*) AS n FROM smp GROUP BY 1) SELECT round(avg(w), 7) AS w, count(*) AS replicas FROM r")
def st_parlearner(spark, d):
    """One step of four replicas on their own samples, then the model average."""
    from tallyforge.functions.special import logistic

    g = (F.col("y") - logistic(F.lit(0.1) * F.col("f1"))) * F.col("f1")
    r = samples(spark, d).groupBy(F.pmod("id", F.lit(4)).alias("replica")).agg((0.1 + 0.5 * F.avg(g)).alias("w"))
    return r.agg(F.round(F.avg("w"), 7).alias("w"), F.count("*").alias("replicas"))


MESSAGES = "msg AS (SELECT event_id AS arrival, event_id // 500 AS round, user_id % 4 AS worker, event_id % 10 AS chunk, CAST(round(value * 100) AS BIGINT) AS value FROM events)"


def messages(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("arrival"), F.floor(F.col("event_id") / 500).alias("round"), (F.col("user_id") % 4).alias("worker"), (F.col("event_id") % 10).alias("chunk"), F.round(F.col("value") * 100).cast("long").alias("value"))


_ONE = f"{MESSAGES}, one AS (SELECT round, chunk, worker, sum(value) AS value FROM msg GROUP BY ALL), red AS (SELECT round, chunk, sum(value) AS s, count(*) AS n FROM one GROUP BY ALL HAVING count(*) >= 4)"


@query("allreduce_avg", f"WITH {_ONE} SELECT round, chunk, round(s / CAST(n AS DOUBLE), 6) AS value, n FROM red")
def allreduce_avg(spark, d):
    m = messages(spark, d).groupBy("round", "chunk", "worker").agg(F.sum("value").alias("value"))
    return R.reduced(m, 4).select("round", "chunk", F.round("value", 6).alias("value"), "n")


@query("allreduce_sum", f"WITH {_ONE} SELECT round, chunk, CAST(s AS BIGINT) AS value FROM red")
def allreduce_sum(spark, d):
    m = messages(spark, d).groupBy("round", "chunk", "worker").agg(F.sum("value").alias("value"))
    return R.reduced(m, 4, kind="sum").select("round", "chunk", "value")


@query("allreduce_custom", f"WITH {MESSAGES}, one AS (SELECT round, chunk, worker, sum(value) AS value FROM msg GROUP BY ALL) SELECT round, chunk, CAST(max(value) - min(value) AS BIGINT) AS value, count(*) AS n FROM one GROUP BY ALL HAVING count(*) >= 2")
def allreduce_custom(spark, d):
    """A reducer of one's own: how far the workers are apart, of chunks that half of them have sent."""
    m = messages(spark, d).groupBy("round", "chunk", "worker").agg(F.sum("value").alias("value"))
    return R.reduced(m, 4, 0.5, lambda v: F.max(v) - F.min(v))


@query("allreduce_fill", f"WITH {_ONE}, own AS (SELECT DISTINCT round, chunk FROM msg) SELECT own.round, own.chunk, round(coalesce(s / CAST(n AS DOUBLE), own.round * 10.0), 6) AS value, s IS NOT NULL AS reduced FROM own LEFT JOIN red USING (round, chunk)")
def allreduce_fill(spark, d):
    m = messages(spark, d).groupBy("round", "chunk", "worker").agg(F.sum("value").alias("value"))
    backup = m.select("round", "chunk").distinct().withColumn("value", F.col("round") * 10.0)
    return R.filled(R.reduced(m, 4), backup).select("round", "chunk", F.round("value", 6).alias("value"), "reduced")


@query("allreduce_outdated", f"WITH {MESSAGES}, late AS (SELECT arrival, CASE WHEN arrival % 11 = 0 THEN round - 2 ELSE round END AS round FROM msg), n AS (SELECT *, max(round) OVER (ORDER BY arrival) AS newest FROM late) SELECT round, count(*) AS n FROM n WHERE round >= newest - 1 GROUP BY round")
def allreduce_outdated(spark, d):
    m = messages(spark, d).withColumn("round", F.when(F.col("arrival") % 11 == 0, F.col("round") - 2).otherwise(F.col("round")))
    return R.current(m, 1).groupBy("round").agg(F.count("*").alias("n"))


@query("elastic_average", f"WITH {_ONE}, mdl AS (SELECT DISTINCT chunk, 100.0::DOUBLE AS value FROM msg), av AS (SELECT chunk, s / CAST(n AS DOUBLE) AS a FROM red WHERE round = 1) SELECT chunk, round(CASE WHEN a IS NULL THEN value ELSE 0.9 * value + 0.1 * a END, 6) AS value FROM mdl LEFT JOIN av USING (chunk)")
def elastic_average(spark, d):
    m = messages(spark, d).groupBy("round", "chunk", "worker").agg(F.sum("value").alias("value"))
    model = m.select("chunk").distinct().withColumn("value", F.lit(100.0))
    return R.blended(model, R.reduced(m, 4).where("round = 1"), ["chunk"], 0.1).select("chunk", F.round("value", 6).alias("value"))


_FIRST = f"{MESSAGES}, fst AS (SELECT round, chunk, worker, min_by(value, arrival) AS value, min(arrival) AS arrival FROM msg GROUP BY ALL), ord AS (SELECT *, row_number() OVER (PARTITION BY round, chunk ORDER BY arrival) AS k FROM fst), sca AS (SELECT round, chunk, sum(value) / CAST(count(*) AS DOUBLE) AS value, count(*) AS n, max(arrival) AS done FROM ord WHERE k <= 3 GROUP BY ALL HAVING count(*) >= 3)"


@query("allreduce_scatter", f"WITH {_FIRST} SELECT round, chunk, round(value, 6) AS value, n, done FROM sca")
def allreduce_scatter(spark, d):
    """Chunks that are sent on when three of four workers have come; a worker's later messages and the last worker are late."""
    return R.scattered(messages(spark, d), 4, 0.75).withColumn("value", F.round("value", 6))


@query("allreduce_complete", f"WITH {_FIRST}, k AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY done, chunk) AS k FROM sca) SELECT round, count(*) AS chunks, max(CASE WHEN k = 8 THEN done END) AS done FROM k GROUP BY round HAVING count(*) >= 8")
def allreduce_complete(spark, d):
    """Rounds complete at eight of ten reduced chunks."""
    return R.completed_rounds(R.scattered(messages(spark, d), 4, 0.75), 10, 0.8)


@query("allreduce_advance", f"""WITH {MESSAGES}, ln AS (SELECT *, user_line AS line FROM (SELECT m.*, e.user_id % 3 AS user_line FROM msg m JOIN events e ON e.event_id = m.arrival)),
w AS (SELECT line, round, count(DISTINCT chunk) AS chunks, max(arrival) AS done FROM ln GROUP BY ALL HAVING count(DISTINCT chunk) >= 10), k AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY done, line) AS k FROM w)
SELECT round, count(*) AS lines, max(CASE WHEN k = 2 THEN done END) AS done FROM k GROUP BY round HAVING count(*) >= 2""")
def allreduce_advance(spark, d):
    """Rounds that two of three lines of workers have finished, so that the next may begin."""
    m = messages(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("arrival"), (F.col("user_id") % 3).alias("line")), "arrival")
    lines = m.groupBy("line", "round").agg(F.count_distinct("chunk").alias("c"), F.max("arrival").alias("done")).where("c >= 10")
    return R.line_masters(lines.select("line", "round", "done"), 3, 0.67)


@query("worker_statistics", f"WITH {MESSAGES} SELECT worker, count(*) AS messages, CAST(sum(value) AS BIGINT) AS total, max(round) AS newest, CAST(max(arrival) - min(arrival) AS BIGINT) AS span FROM msg GROUP BY worker")
def worker_statistics(spark, d):
    """What each worker has sent."""
    return messages(spark, d).groupBy("worker").agg(F.count("*").alias("messages"), F.sum("value").alias("total"), F.max("round").alias("newest"), (F.max("arrival") - F.min("arrival")).alias("span"))


@query("grid_layout", "WITH p AS (SELECT c_custkey AS node, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer), s AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS s FROM customer) SELECT node, p // s AS grid_row, p % s AS grid_col FROM p, s")
def grid_layout(spark, d):
    return R.grid_places(table(spark, d, "customer").select(F.col("c_custkey").alias("node")))


@query("grid_changes", "WITH a AS (SELECT c_custkey AS node, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer), s AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS s FROM customer), b AS (SELECT c_custkey AS node, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer WHERE c_mktsegment <> 'BUILDING'), t AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS t FROM customer WHERE c_mktsegment <> 'BUILDING') SELECT a.p // s.s = b.p // t.t AS same_row, a.p % s.s = b.p % t.t AS same_col, count(*) AS n FROM a JOIN b USING (node), s, t GROUP BY ALL")
def grid_changes(spark, d):
    """Nodes leave, the rest is laid out anew: how many keep their row's and column's master."""
    c = table(spark, d, "customer")
    before = R.grid_places(c.select(F.col("c_custkey").alias("node"))).select("node", F.col("grid_row").alias("r"), F.col("grid_col").alias("c"))
    after = R.grid_places(c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("node")))
    return before.join(after, "node").groupBy((F.col("r") == F.col("grid_row")).alias("same_row"), (F.col("c") == F.col("grid_col")).alias("same_col")).agg(F.count("*").alias("n"))


@query("model_merge_trees", f"""WITH {LINES}, v AS (SELECT sample, {VOTES_A[0]} + {VOTES_A[1]} + {VOTES_B} AS s FROM lin) SELECT sample, round(sum(s) / (3 * count(*)), 6) AS mean FROM v GROUP BY sample""")
def model_merge_trees(spark, d):
    """The merged forest of two workers predicts by all their trees."""
    from tallyforge.operators import forest
    from tallyforge.plans.model_plans import FOREST_A, FOREST_B, forest_tables, forest_votes

    (ia, la), (ib, lb) = forest_tables(spark, FOREST_A), forest_tables(spark, FOREST_B)
    v = forest_votes(spark, d, forest.merge(ia, ib), forest.merge(la, lb), 3)
    return v.groupBy("sample").agg(F.round(F.avg("vote"), 6).alias("mean"))


@query("gradient_clip_windows", "SELECT event_id // 1000 AS block, round(avg(greatest(-5, least(5, value - 10))), 6) AS g FROM events GROUP BY 1")
def gradient_clip_windows(spark, d):
    from tallyforge.operators.updaters import clip_value

    return table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 1000).cast("long").alias("block")).agg(F.round(F.avg(clip_value(F.col("value") - 10, 5.0)), 6).alias("g"))
