"""Sources, sinks and reshaping over the tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from tallyforge.operators import transform as X
from tallyforge.plans.catalog import query
from tallyforge.plans.fixtures import RATINGS, SAMPLES, TOKENS, counts, dense, ratings, samples, table, tokens
from tallyforge.scratch import scratch
from tallyforge.sources import files, text_formats

HASH = "(({k} * 1103515245 + 12345) % 2147483648) % 1000 < {t}"


@query("src_mat", f"WITH {SAMPLES}, b AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 1000 AS batch_id FROM smp) SELECT batch_id, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM b GROUP BY batch_id")
def src_mat(spark, d):
    return X.batches(samples(spark, d), ("id",), 1000).groupBy("batch_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("src_putback", f"WITH {SAMPLES} SELECT id, y, CASE WHEN f1 > 0.5 THEN 1 ELSE 0 END AS pred FROM smp")
def src_putback(spark, d):
    return samples(spark, d).select("id", "y", F.when(F.col("f1") > 0.5, 1).otherwise(0).alias("pred"))


@query("src_file", "SELECT 0 AS file_no, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 1, count(*) FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT 2, count(*) FROM orders WHERE o_orderkey % 3 = 2")
def src_file(spark, d):
    from tallyforge.scratch import scratch

    base = scratch(spark, "numbered")
    for n in range(3):
        table(spark, d, "orders").where(F.col("o_orderkey") % 3 == n).write.mode("overwrite").parquet(f"{base}/part%05d" % n)
    return files.read_numbered(spark, f"{base}/part%05d", 0).groupBy("file_no").agg(F.count("*").alias("n"))


@query(
    "src_datepath",
    """WITH n AS (SELECT o_orderkey, 372 * year(o_orderdate) + 31 * month(o_orderdate) + day(o_orderdate) AS code FROM orders)
SELECT o_orderkey, code, (code - 32) // 372 AS y, ((code - 32) % 372) // 31 + 1 AS m, (code - 32) % 31 - 0 + 1 AS dd FROM (SELECT o_orderkey, code FROM n)""",
)
def src_datepath(spark, d):
    day = F.col("o_orderdate")
    n = table(spark, d, "orders").select("o_orderkey", files.encode_date(F.year(day), F.month(day), F.dayofmonth(day)).cast("long").alias("code"))
    y, m, dd = files.decode_date(F.col("code"))
    return n.select("o_orderkey", "code", y.cast("long").alias("y"), m.cast("long").alias("m"), dd.cast("long").alias("dd"))


@query(
    "src_sfile",
    """WITH a AS (SELECT o_custkey AS sample, l_suppkey AS feature, count(*) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
b AS (SELECT o_custkey AS sample, l_partkey AS feature, count(*) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT sample, feature, value FROM a WHERE feature < 50 UNION ALL SELECT sample, feature + 50, value FROM b WHERE feature < 400""",
)
def src_sfile(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    part = lambda c: j.groupBy(F.col("o_custkey").alias("sample"), F.col(c).alias("feature")).agg(F.count("*").alias("value"))
    return X.stacked([(part("l_suppkey"), 50), (part("l_partkey"), 400)])


@query("src_iter", "SELECT CAST(l_linenumber AS BIGINT) AS part, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1")
def src_iter(spark, d):
    """Batches pass through an iterator of frames, as an outside consumer would take them."""

    def run(parts):
        for pdf in parts:
            g = pdf.groupby("l_linenumber")["l_quantity"].agg(["count", "sum"]).reset_index()
            g.columns = ["part", "n", "q"]
            yield g

    got = table(spark, d, "lineitem").select("l_linenumber", "l_quantity").mapInPandas(run, "part long, n long, q double")
    return got.groupBy("part").agg(F.sum("n").alias("n"), F.round(F.sum("q"), 2).alias("q"))


@query("src_array", "SELECT CAST(i AS BIGINT) AS id, CAST(i * i AS BIGINT) AS v FROM range(0, 100) t(i)")
def src_array(spark, d):
    return spark.createDataFrame([(i, i * i) for i in range(100)], "id long, v long")


@query("src_stack", f"WITH {SAMPLES} SELECT id, f1, y FROM smp")
def src_stack(spark, d):
    s = samples(spark, d)
    return X.zipped(s.select("id", "f1"), s.select("id", "y"), "id")


@query(
    "src_blend",
    f"SELECT 'c' AS kind, c_custkey AS k, c_acctbal AS v FROM customer WHERE {HASH.format(k='c_custkey', t=300)} UNION ALL SELECT 's', s_suppkey, s_acctbal FROM supplier WHERE NOT ({HASH.format(k='s_suppkey', t=300)})",
)
def src_blend(spark, d):
    a = table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    b = table(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return X.blend(a, b, "k", 0.3)


@query(
    "src_feat",
    f"WITH {TOKENS}, c AS (SELECT doc_id, tok, CAST(count(*) AS DOUBLE) AS cnt FROM tok GROUP BY ALL) SELECT doc_id, sum(least(1.0, cnt)) AS present, sum(cnt) AS total, sum(CASE WHEN cnt >= 3 THEN 1.0 ELSE 0.0 END) AS often FROM c GROUP BY doc_id",
)
def src_feat(spark, d):
    v = F.col("cnt").cast("double")
    return counts(spark, d).groupBy("doc_id").agg(F.sum(X.feature_value(v, 0)).alias("present"), F.sum(X.feature_value(v, 1)).alias("total"), F.sum(X.feature_value(v, 2, 3)).alias("often"))


@query(
    "src_delim",
    "SELECT CAST(o_orderkey AS BIGINT) AS k, o_totalprice AS price, o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 10 <> 0",
)
def src_delim(spark, d):
    o = table(spark, d, "orders")
    good = F.concat_ws("\t", F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd"))
    lines = o.select(F.when(F.col("o_orderkey") % 10 == 0, F.lit("broken line")).otherwise(good).alias("value"))
    return text_formats.read_delimited(lines, text_formats.parse_spec("dint k\ndouble price\nword priority\ndt day")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "src_vw",
    """SELECT l_orderkey AS id, CASE WHEN max(l_returnflag) = 'R' THEN 1.0 ELSE -1.0 END AS label, 'n' AS namespace, 'lines' AS name, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1
UNION ALL SELECT l_orderkey, CASE WHEN max(l_returnflag) = 'R' THEN 1.0 ELSE -1.0 END, 'c', 's' || max(l_linestatus), 1.0 FROM lineitem GROUP BY 1""",
)
def src_vw(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_returnflag").alias("r"), F.max("l_linestatus").alias("s"), F.count("*").alias("n"))
    line = F.concat(F.when(F.col("r") == "R", "1").otherwise("-1"), F.lit(" |n lines:"), F.col("n").cast("string"), F.lit(" |c s"), F.col("s"))
    return text_formats.read_namespaces(g.select("id", line.alias("value")))


@query("src_tfrecord", "SELECT c_mktsegment AS segment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1")
def src_tfrecord(spark, d):
    """Framed record files, written by partition and read back with their checksums: a customer a record."""
    from tallyforge.scratch import scratch

    path = scratch(spark, "records")
    rows = table(spark, d, "customer").select(F.encode(F.concat_ws("\t", "c_custkey", "c_mktsegment"), "utf-8").alias("record"))
    files.write_records(rows, "record", path)
    text = F.split(F.decode("record", "utf-8"), "\t")
    back = files.read_records(spark, path).select(text[0].cast("long").alias("k"), text[1].alias("segment"))
    return back.groupBy("segment").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


@query("src_matfiles", "SELECT CAST(s_suppkey AS BIGINT) AS \"row\", CAST(s_nationkey AS BIGINT) AS col, CAST(s_acctbal AS DOUBLE) AS value FROM supplier")
def src_matfiles(spark, d):
    """A sparse matrix written as text triples and read with its schema."""
    from tallyforge.scratch import scratch

    path = scratch(spark, "matrix")
    table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").write.mode("overwrite").csv(path, sep=" ")
    return spark.read.schema(text_formats.MATRIX).csv(path, sep=" ")


@query(
    "src_criteo",
    "SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, CAST(o_custkey AS INTEGER) AS i1, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey AS INTEGER) END AS i2, o_orderkey AS c1, CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 4 END AS present, o_orderkey AS k FROM (SELECT *, o_orderkey FROM orders)",
)
def src_criteo(spark, d):
    o = table(spark, d, "orders")
    line = F.concat_ws(
        "\t",
        F.when(F.col("o_orderstatus") == "F", "1").otherwise("0"),
        F.col("o_custkey").cast("string"),
        F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderkey").cast("string")),
        F.hex("o_orderkey"),
        F.hex("o_orderkey"),
    )
    got = text_formats.read_clicks(o.select(line.alias("value")), ints=2, hexes=2)
    return got.select("label", "i1", "i2", "c1", F.aggregate("present", F.lit(0), lambda a, x: a + x).alias("present"), F.col("c2").alias("k"))


@query(
    "src_movielens",
    f'WITH {RATINGS} SELECT "user", item, rating, CASE WHEN (((("user" * 100003 + item) * 1103515245 + 12345) % 2147483648) % 1000) < 900 THEN 1 ELSE 0 END AS train FROM rat',
)
def src_movielens(spark, d):
    r = ratings(spark, d)
    return r.withColumn("train", X.hashed_share(F.col("user") * 100003 + F.col("item"), 0.9).cast("int"))


@query(
    "src_other_prep",
    "SELECT c_custkey AS sample, CAST(list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) AS BIGINT) AS cls, c_nationkey * 5 + list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) AS cell FROM customer",
)
def src_other_prep(spark, d):
    """Category matrix by linear index."""
    order = F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    return table(spark, d, "customer").select(F.col("c_custkey").alias("sample"), F.array_position(order, F.col("c_mktsegment")).alias("cls"), (F.col("c_nationkey") * 5 + F.array_position(order, F.col("c_mktsegment"))).alias("cell"))


@query(
    "src_digits",
    "WITH s AS (SELECT event_id, value, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS record, event_type = 'error' AS blank FROM events) SELECT CAST(record AS BIGINT) AS record, count(*) AS n FROM s WHERE NOT blank GROUP BY 1",
)
def src_digits(spark, d):
    return text_formats.segments(table(spark, d, "events"), "event_id", F.col("event_type") == "error").groupBy("record").agg(F.count("*").alias("n"))


@query("sink_mat", f"WITH {SAMPLES} SELECT id, f1, f2 FROM smp")
def sink_mat(spark, d):
    """Results gathered as one table that later steps read."""
    from tallyforge.scratch import kept

    return kept(samples(spark, d).select("id", "f1", "f2"), "sink")


@query("sink_file", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders")
def sink_file(spark, d):
    from tallyforge.scratch import scratch

    path = scratch(spark, "blocks")
    files.write_blocks(table(spark, d, "orders"), path, 1000)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("model_save_load", f"WITH {SAMPLES} SELECT y, count(*) AS n FROM smp GROUP BY y")
def model_save_load(spark, d):
    from tallyforge.scratch import scratch

    keep = files.Checkpoints(spark, scratch(spark, "model"), keep=2)
    for v in range(3):
        keep.save(v, {"pass": v}, weights=samples(spark, d).groupBy("y").agg(F.count("*").alias("n")))
    return keep.load("weights")[1]["weights"]


@query("w2v_io", "SELECT CAST(vec_id AS VARCHAR) AS word, CAST(len(embedding) AS INTEGER) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS x1 FROM embeddings")
def w2v_io(spark, d):
    e = dense(spark, d, 1, 64)
    back = text_formats.read_vectors(text_formats.write_vectors(e, "vec_id", "x"))
    return back.select("word", F.size("vector").alias("dims"), F.round(F.get("vector", F.lit(0)), 6).alias("x1"))


@query("log_sink", "WITH t AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT label, round(sum(abs(x)), 4) AS l1, round(sqrt(sum(x * x)), 4) AS l2 FROM t GROUP BY label")
def log_sink(spark, d):
    x = dense(spark, d, 1, 64).select("label", F.explode("x").alias("x"))
    return x.groupBy("label").agg(F.round(F.sum(F.abs("x")), 4).alias("l1"), F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 4).alias("l2"))


# Reshaping ---------------------------------------------------------------------------------------------------------


@query("col_slice", f"WITH {SAMPLES} SELECT id, f1, f2, f3, y FROM smp WHERE id BETWEEN 100 AND 199")
def col_slice(spark, d):
    return samples(spark, d).where("id between 100 and 199")


@query("row_slice", "WITH t AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT vec_id, i, x FROM t WHERE i BETWEEN 9 AND 16")
def row_slice(spark, d):
    return dense(spark, d, 9, 8).select("vec_id", F.posexplode("x").alias("i", "x")).withColumn("i", F.col("i") + 9)


@query("gather_cols", f"WITH {SAMPLES}, ix AS (SELECT CAST(i AS BIGINT) AS place, (i * 7919) % 1000 + 1 AS id FROM range(0, 500) t(i)) SELECT place, id, f1 FROM ix JOIN smp USING (id)")
def gather_cols(spark, d):
    index = spark.range(500).select(F.col("id").alias("place"), (F.col("id") * 7919 % 1000 + 1).alias("id"))
    return samples(spark, d).join(index, "id").select("place", "id", "f1")


@query("row_mask", f"WITH {TOKENS} SELECT doc_id, tok, count(*) AS cnt FROM tok WHERE tok NOT IN ('the', 'of', 'de', 'la') GROUP BY ALL")
def row_mask(spark, d):
    masked = spark.createDataFrame([(w,) for w in ("the", "of", "de", "la")], "tok string")
    return tokens(spark, d).join(F.broadcast(masked), "tok", "left_anti").groupBy("doc_id", "tok").agg(F.count("*").alias("cnt"))


@query("target_rows", f"WITH {TOKENS}, g(target, tok) AS (VALUES (0, 'the'), (0, 'of'), (1, 'de'), (1, 'la')) SELECT doc_id, target, least(count(*), 1) AS hit FROM tok JOIN g USING (tok) GROUP BY ALL")
def target_rows(spark, d):
    g = spark.createDataFrame([(0, "the"), (0, "of"), (1, "de"), (1, "la")], "target int, tok string")
    return tokens(spark, d).join(F.broadcast(g), "tok").groupBy("doc_id", "target").agg(F.least(F.count("*"), F.lit(1)).alias("hit"))


@query("target_map", f"WITH {SAMPLES}, grid AS (SELECT a, b FROM (VALUES (0.1::DOUBLE), (1.0::DOUBLE)) x(a), (VALUES (1), (2), (3)) z(b)) SELECT a, b, y, count(*) AS n FROM smp, grid GROUP BY ALL")
def target_map(spark, d):
    grid = spark.createDataFrame([(0.1,), (1.0,)], "a double").crossJoin(spark.createDataFrame([(1,), (2,), (3,)], "b int"))
    return samples(spark, d).crossJoin(F.broadcast(grid)).groupBy("a", "b", "y").agg(F.count("*").alias("n"))


@query("sample_weight", f"WITH {SAMPLES} SELECT y, round(sum(f1 * f2) / sum(f1), 6) AS wmean FROM smp GROUP BY y")
def sample_weight(spark, d):
    return samples(spark, d).groupBy("y").agg(F.round(F.sum(F.col("f1") * F.col("f2")) / F.sum("f1"), 6).alias("wmean"))


@query("find_filter", "WITH t AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT vec_id, i, x FROM t WHERE x > 0.2")
def find_filter(spark, d):
    return dense(spark, d, 1, 64).select("vec_id", F.posexplode("x").alias("i", "x")).withColumn("i", F.col("i") + 1).where("x > 0.2")


@query("sparse_build", 'SELECT l_orderkey AS "row", l_partkey AS col, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem GROUP BY ALL')
def sparse_build(spark, d):
    return X.sparse(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), "l_quantity"), "row", "col", F.col("l_quantity").cast("long"))


@query(
    "full_dense",
    """WITH s AS (SELECT c_nationkey AS a, c_mktsegment AS b, count(*) AS value FROM customer WHERE c_acctbal > 9000 GROUP BY ALL)
SELECT n_nationkey AS a, seg.b, coalesce(value, 0) AS value FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS b FROM customer) seg LEFT JOIN s ON s.a = n_nationkey AND s.b = seg.b""",
)
def full_dense(spark, d):
    c = table(spark, d, "customer")
    s = c.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("a"), F.col("c_mktsegment").alias("b")).agg(F.count("*").alias("value"))
    return X.full(s, table(spark, d, "nation").select(F.col("n_nationkey").alias("a")), c.select(F.col("c_mktsegment").alias("b")).distinct())


@query(
    "const_feature",
    "WITH s AS (SELECT o_custkey AS sample, o_orderpriority AS p, count(*) AS c FROM orders GROUP BY ALL), t AS (SELECT sample, CAST(substr(p, 1, 1) AS BIGINT) AS feature, CAST(c AS DOUBLE) AS value FROM s) SELECT * FROM t UNION ALL SELECT DISTINCT sample, 9, 1.0 FROM t",
)
def const_feature(spark, d):
    t = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("sample"), F.substring("o_orderpriority", 1, 1).cast("long").alias("feature")).agg(F.count("*").cast("double").alias("value"))
    return X.with_constant(t, 9)


@query("clip", f"WITH {SAMPLES} SELECT id, greatest(0.3::DOUBLE, least(0.7::DOUBLE, f1)) AS v FROM smp")
def clip(spark, d):
    return samples(spark, d).select("id", X.clip(F.col("f1"), 0.3, 0.7).alias("v"))


@query("clear_high_bit", "SELECT o_orderkey AS k, (o_orderkey * 1103515245) & 2147483647 AS v FROM orders")
def clear_high_bit(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 1103515245).bitwiseAND(F.lit(0x7FFFFFFF)).alias("v"))


@query("random_split", f"SELECT o_orderkey AS k, CASE WHEN {HASH.format(k='o_orderkey', t=800)} THEN 'train' ELSE 'test' END AS part FROM orders")
def random_split(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(X.hashed_share(F.col("o_orderkey"), 0.8), "train").otherwise("test").alias("part"))


@query(
    "sort_features",
    "WITH n AS (SELECT l_partkey AS feature, row_number() OVER (ORDER BY count(*) DESC, l_partkey) - 1 AS new_feature FROM lineitem GROUP BY 1) SELECT l_orderkey AS sample, new_feature, count(*) AS value FROM lineitem JOIN n ON feature = l_partkey GROUP BY ALL",
)
def sort_features(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_partkey").alias("feature"))
    return X.renumbered(t).groupBy("sample", "new_feature").agg(F.count("*").alias("value"))


@query("src_base", f"WITH {SAMPLES}, b AS (SELECT id, f1, (row_number() OVER (ORDER BY id) - 1) // 400 AS b FROM smp) SELECT b AS batch, count(*) AS n, round(sum(f1), 6) AS s FROM b GROUP BY b UNION ALL SELECT -1, count(*), round(sum(f1), 6) FROM b WHERE b = 0")
def src_base(spark, d):
    """A source's batches, the first put back once, through a transformation into a sink."""
    from tallyforge.sources.contracts import Sink, Source

    source, sink = Source(samples(spark, d).select("id", "f1"), ("id",), 400).start(), Sink()
    sums = [F.count("*").alias("n"), F.round(F.sum("f1"), 6).alias("s")]
    first = source.next()
    source.put_back(first)
    sink.put(first.agg(F.lit(-1).cast("long").alias("batch"), *sums))
    sink.put(source.rest().groupBy(F.col("turn").alias("batch")).agg(*sums))
    return sink.table()


@query("up_base", "WITH m AS (SELECT s_suppkey AS key, (s_suppkey % 11 - 5) / 10.0::DOUBLE AS w, (s_suppkey % 13 - 6) / 10.0::DOUBLE AS g FROM supplier) SELECT key, round(w + 0.1::DOUBLE * g + (0.9::DOUBLE * 0.1 * g + 0.1::DOUBLE * g), 6) + 0.0::DOUBLE AS w, round(0.9::DOUBLE * 0.1 * g + 0.1::DOUBLE * g, 6) + 0.0::DOUBLE AS v FROM m")
def up_base(spark, d):
    """Two steps of an update rule with a state of its own."""
    from tallyforge.sources.contracts import MomentumRule

    k = F.col("s_suppkey")
    m = table(spark, d, "supplier").select(k.alias("key"), ((k % 11 - 5) / 10.0).alias("w"), ((k % 13 - 6) / 10.0).alias("g"))
    rule, g = MomentumRule(0.1, 0.9), m.select("key", "g")
    model = rule.start(m.select("key", "w"))
    for number in range(2):
        model = rule.apply(model, g, number)
    return model.select("key", (F.round("w", 6) + 0.0).alias("w"), (F.round("v", 6) + 0.0).alias("v"))


@query("src_nend_discover", "SELECT CAST(p AS INTEGER) AS file_no, count(*) AS n FROM (SELECT o_orderkey % 5 AS p FROM orders) WHERE p < 3 GROUP BY 1")
def src_nend_discover(spark, d):
    """Files 2, 3, 4 and 6 are there: reading begins at the first and ends at the gap."""
    base, o = scratch(spark, "gaps"), table(spark, d, "orders")
    for part, number in enumerate((2, 3, 4, 6)):
        o.where(F.col("o_orderkey") % 5 == part).write.parquet(f"{base}/day%03d" % number)
    return files.read_numbered(spark, f"{base}/day%03d", 0).groupBy("file_no").agg(F.count("*").alias("n"))


@query("w2v_binary", "SELECT CAST(vec_id AS VARCHAR) AS word, CAST(len(embedding) AS INTEGER) AS dims, round(CAST(CAST(embedding[1] AS FLOAT) AS DOUBLE), 5) AS x1, round(CAST(CAST(embedding[64] AS FLOAT) AS DOUBLE), 5) AS x64 FROM embeddings")
def w2v_binary(spark, d):
    """Vectors through binary files and back."""
    path = scratch(spark, "vectors")
    files.write_binary_vectors(dense(spark, d, 1, 64), "vec_id", "x", 64, path)
    back = files.read_binary_vectors(spark, path)
    return back.select("word", F.size("vector").alias("dims"), *[F.round(F.get("vector", F.lit(i)).cast("double"), 5).alias(n) for i, n in ((0, "x1"), (63, "x64"))])


@query("model_delete", "SELECT FALSE AS found, TRUE AS deleted")
def model_delete(spark, d):
    """A saved model that was deleted can't be read."""
    path = scratch(spark, "gone")
    files.save_model(path, {"k": 1}, m=table(spark, d, "region"))
    deleted = files.delete_model(spark, path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.createDataFrame([(bool(there), bool(deleted))], "found boolean, deleted boolean")


_HASHED = lambda run, share: f"(({run}) * 1103515245 + 12345) % 2147483648 % 1000 < {int(share * 1000)}"


@query("src_blend_runs", f"WITH p AS (SELECT event_id, event_id // 50 AS run FROM events) SELECT CASE WHEN {_HASHED('run', 0.6)} THEN 'a' ELSE 'b' END AS source, run, count(*) AS n FROM p WHERE CASE WHEN {_HASHED('run', 0.6)} THEN {_HASHED('run + 104729', 0.9)} ELSE {_HASHED('run + 224737', 0.5)} END GROUP BY ALL")
def src_blend_runs(spark, d):
    """Two sources in runs of fifty: six runs of ten from the first, of which nine tenths are taken, of the second's half."""
    e = table(spark, d, "events").select("event_id")
    mixed = X.blend_runs(e.withColumn("source", F.lit("a")), e.withColumn("source", F.lit("b")), "event_id", 50, 0.6, 0.9, 0.5)
    return mixed.groupBy("source", F.floor(F.col("event_id") / 50).cast("long").alias("run")).agg(F.count("*").alias("n"))
