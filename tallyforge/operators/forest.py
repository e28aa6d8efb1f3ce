"""Decision forests: histograms, splits, routing and votes as joins and windows. Nodes: (tree, node, feature, threshold, left, label)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.special import arithmetic_hash


def histogram(samples: DataFrame, n_features: int, draws: int, label: str) -> DataFrame:
    """(tree, node, feature, value, label, n) of samples with tree, node and xs: each node looks at `draws` features
    that a hash of tree, node and draw picks, once each. The nodes of a level are a small table (trees times 2 to the
    depth, times draws), which is broadcast, so that no sample is shuffled to drop a repeated draw."""
    drawn = samples.select("tree", "node").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    f = arithmetic_hash([F.col("tree").cast("long"), F.col("node").cast("long"), F.col("draw").cast("long")], n_features)
    looked = drawn.select("tree", "node", f.alias("feature")).distinct()
    picked = samples.join(F.broadcast(looked), ["tree", "node"])
    return picked.withColumn("value", F.get("xs", F.col("feature").cast("int"))).groupBy("tree", "node", "feature", "value", label).agg(F.count("*").alias("n"))


#: An impurity of one's own: from the counts of the classes and their sum, the impurity times that sum.
Impurity = Callable[[list[Column], Column], Column]


def _impurity(counts: list[Column], total: Column, kind: str | Impurity) -> Column:
    if callable(kind):
        return kind(counts, total)
    if kind == "gini":
        return total - sum((c * c for c in counts), F.lit(0.0)) / total
    s = sum((F.when(c > 0, c * F.ln(c)).otherwise(0.0) for c in counts), F.lit(0.0))
    return total * F.ln(total) - s


def splits(hist: DataFrame, label: str, classes: list, kind: str | Impurity = "entropy") -> DataFrame:
    """(tree, node, feature, threshold, gain) of the best split of each node: value <= threshold goes left. Gain is the
    mean impurity that the split takes away; of equal gains the smallest feature and threshold. One window over the
    distinct values of a feature, with the classes side by side."""
    by = ["tree", "node", "feature"]
    wide = hist.groupBy(*by, "value").agg(*[F.sum(F.when(F.col(label) == c, F.col("n")).otherwise(0)).cast("double").alias(f"c{i}") for i, c in enumerate(classes)])
    upto, every = Window.partitionBy(*by).orderBy("value"), Window.partitionBy(*by)
    for i in range(len(classes)):
        wide = wide.withColumn(f"l{i}", F.sum(f"c{i}").over(upto)).withColumn(f"t{i}", F.sum(f"c{i}").over(every))
    left = [F.col(f"l{i}") for i in range(len(classes))]
    every_ = [F.col(f"t{i}") for i in range(len(classes))]
    right = [t - x for t, x in zip(every_, left)]
    nl, nt = sum(left, F.lit(0.0)), sum(every_, F.lit(0.0))
    gain = (_impurity(every_, nt, kind) - _impurity(left, nl, kind) - _impurity(right, nt - nl, kind)) / nt
    g = wide.where(nl < nt).withColumn("gain", F.round(gain, 9))
    best = g.groupBy("tree", "node").agg(F.min_by(F.struct("feature", F.col("value").alias("threshold"), "gain"), F.struct(-F.col("gain"), F.col("feature"), F.col("value"))).alias("b"))
    return best.select("tree", "node", "b.feature", "b.threshold", "b.gain")


def leaf_labels(samples: DataFrame, label: str) -> DataFrame:
    """(tree, node, label): the commonest label of each node; of equal ones the smallest."""
    n = samples.groupBy("tree", "node", label).agg(F.count("*").alias("n"))
    return n.groupBy("tree", "node").agg(F.min_by(F.col(label), F.struct(-F.col("n"), F.col(label))).alias("label"))


def step(samples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Moves each sample one level down: to child 2n + 1 or, above the threshold, 2n + 2. Nodes are a model of bounded
    depth (at most 2**depth - 1 rows a tree)."""
    j = samples.join(F.broadcast(nodes.select("tree", "node", F.col("feature").alias("__f"), F.col("threshold").alias("__t"))), ["tree", "node"], "left")
    go = F.when(F.col("__f").isNull(), F.col("node")).otherwise(2 * F.col("node") + 1 + (F.get("xs", F.col("__f").cast("int")) > F.col("__t")).cast("long"))
    return j.withColumn("node", go).drop("__f", "__t")


def grow(samples: DataFrame, n_features: int, label: str, classes: list, trees: int = 2, depth: int = 3, draws: int = 2, least_gain: float = 0.01, kind: str | Impurity = "entropy") -> tuple[DataFrame, DataFrame]:
    """(inner nodes, leaf labels) of a forest grown level by level; samples: (sample, xs, label). Each tree sees the rows
    that a hash of tree and sample keeps (two of three)."""
    spark = samples.sparkSession
    s = samples.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("node", F.lit(0).cast("long"))
    s = s.where(arithmetic_hash([F.col("tree").cast("long") + 7, F.col("sample").cast("long")], 3) > 0)
    schema = "tree int, node long, feature long, threshold double, gain double"
    inner: list[tuple] = []
    frontier = s
    for _ in range(depth):
        found = splits(histogram(frontier, n_features, draws, label), label, classes, kind).where(F.col("gain") > least_gain)
        level = [(r["tree"], r["node"], r["feature"], float(r["threshold"]), r["gain"]) for r in found.collect()]  # at most 2**depth a tree
        if not level:
            break
        inner += level
        frontier = step(frontier, spark.createDataFrame(level, schema))
    return spark.createDataFrame(inner, schema), leaf_labels(frontier, label)


def predict(samples: DataFrame, inner: DataFrame, leaves: DataFrame, depth: int, trees: int) -> DataFrame:
    """(sample, tree, label) votes."""
    s = samples.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("node", F.lit(0).cast("long"))
    for _ in range(depth):
        s = step(s, inner)
    return s.join(F.broadcast(leaves.withColumnRenamed("label", "vote")), ["tree", "node"]).select("sample", "tree", "vote")


def literal_walk(xs: Column, tree: dict) -> Column:
    """A fixed tree as nested conditions: {feature, threshold, low, high}, leaves are numbers."""
    if not isinstance(tree, dict):
        return F.lit(tree)
    return F.when(F.get(xs, F.lit(tree["feature"])) > tree["threshold"], literal_walk(xs, tree["high"])).otherwise(literal_walk(xs, tree["low"]))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two forests as one: b's trees are numbered after a's."""
    offset = a.agg((F.coalesce(F.max("tree"), F.lit(-1)) + 1).alias("o"))
    return a.unionByName(b.crossJoin(F.broadcast(offset)).withColumn("tree", (F.col("tree") + F.col("o")).cast("int")).drop("o"))


def bits(n: int) -> int:
    return math.ceil(math.log2(n)) if n > 1 else 0
