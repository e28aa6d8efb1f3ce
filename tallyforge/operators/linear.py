"""Products of sparse and dense matrices as joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spmm(triples: DataFrame, model: DataFrame, small: bool = False) -> DataFrame:
    """(target, sample, value): model (target, feature, w) times data (sample, feature, x).

    `small`: the caller has checked that the model is small enough to be sent to every task."""
    m = F.broadcast(model) if small else model
    return triples.join(m, "feature").groupBy("target", "sample").agg(F.sum(F.col("w") * F.col("x")).alias("value"))


def spmm_t(triples: DataFrame, eta: DataFrame) -> DataFrame:
    """(target, feature, value): outer accumulation of eta (target, sample, e) over data (sample, feature, x)."""
    return triples.join(eta, "sample").groupBy("target", "feature").agg(F.sum(F.col("e") * F.col("x")).alias("value"))


def sddmm(triples: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Adds `dot` to triples (row, col, value): the product of factor arrays l of its row and r of its column."""
    j = triples.join(left, "row").join(right, "col")
    return j.withColumn("dot", F.aggregate(F.zip_with("l", "r", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)).drop("l", "r")


#: Features of a sample that one group holds; a sample with more is crossed by pairs of blocks of half as many.
CROSS = 1024


def pair_cross(triples: DataFrame, sample: str, feature: str, value: str, with_self: bool = True, most: int = CROSS) -> DataFrame:
    """(sample, f1, f2, value) for pairs f1 >= f2 of a sample's features: the features travel as one sorted array a sample, and
    pairs are made inside the row. A sample with more than `most` features is dealt by pairs of blocks, so that no group
    is larger, and every pair is still made once: within a block, or between two."""
    t = triples.select(F.col(sample).alias("s"), F.struct(F.col(feature).alias("f"), F.col(value).alias("v")).alias("x"))
    sizes = t.groupBy("s").agg(F.ceil(F.count("*") / F.lit(most / 2)).cast("int").alias("k"))
    dealt = t.join(sizes, "s").withColumn("k", F.when(F.col("k") <= 2, 1).otherwise(F.col("k")))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("x.f"), F.col("k").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    groups = dealt.groupBy("s", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(F.array_sort(F.collect_list(F.struct(F.col("x.f").alias("f"), F.col("x.v").alias("v"), F.col("own").alias("o")))).alias("fs"))
    one = groups.select("s", "a", "b", "fs", F.explode("fs").alias("p"))
    larger = (lambda q: F.col("p.f") >= q["f"]) if with_self else (lambda q: F.col("p.f") > q["f"])
    across = lambda q: (F.col("a") == F.col("b")) | (q["o"] != F.col("p.o"))
    both = one.select("s", "p", F.explode(F.filter("fs", lambda q: larger(q) & across(q))).alias("q"))
    return both.select(F.col("s").alias(sample), F.col("p.f").alias("f1"), F.col("q.f").alias("f2"), (F.col("p.v") * F.col("q.v")).alias("value"))


def select_row(df: DataFrame, array: str, index: str) -> DataFrame:
    return df.withColumn("picked", F.get(F.col(array), F.col(index)))


def gram(long: DataFrame, sample: str = "id", feature: str = "i", value: str = "x") -> DataFrame:
    """(i, j, value), i <= j: sums over samples of products of features."""
    a = long.select(F.col(sample), F.col(feature).alias("i"), F.col(value).alias("__a"))
    b = long.select(F.col(sample), F.col(feature).alias("j"), F.col(value).alias("__b"))
    return a.join(b, sample).where("i <= j").groupBy("i", "j").agg(F.sum(F.col("__a") * F.col("__b")).alias("value"))


def gram_arrays(df: DataFrame, array: str, n: int) -> DataFrame:
    """(i, j, value), i <= j from arrays of n numbers: every sum is taken in one pass, without a join."""
    sums = [F.sum(F.get(array, F.lit(i)) * F.get(array, F.lit(j))).alias(f"g_{i}_{j}") for i in range(n) for j in range(i, n)]
    one = df.agg(*sums)
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g_{i}_{j}").alias("value")) for i in range(n) for j in range(i, n)])).alias("t")).select("t.*")


def run_boundaries(df: DataFrame, order: tuple[str, ...], key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds run: the number, from 1, of the stretch of equal keys that a row stands in."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return df.withColumn("__c", change).withColumn("run", F.sum("__c").over(w)).drop("__c")
