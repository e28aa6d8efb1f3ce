"""Projection, filtering and reshaping of samples: dense rows (arrays) and sparse triples (sample, feature, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.ordering import rank_by_count, row_numbers


def batches(df: DataFrame, order: tuple[str, ...], size: int) -> DataFrame:
    """Adds batch_id: consecutive blocks of `size` rows in the given order; the last may be short."""
    return row_numbers(df, order, "batch_id").withColumn("batch_id", F.floor(F.col("batch_id") / size).cast("long"))


def feature_value(x: Column, kind: int, threshold: float = 0.0) -> Column:
    """0: presence capped at one, 1: the value, 2: whether it reaches a threshold."""
    return {0: F.least(F.lit(1.0), x), 1: x, 2: (x >= threshold).cast("double")}[kind]


def with_constant(triples: DataFrame, feature: int, sample: str = "sample", value: str = "value") -> DataFrame:
    """A feature that is one in every sample."""
    ones = triples.select(sample).distinct().select(sample, F.lit(feature).cast("long").alias("feature"), F.lit(1.0).alias(value))
    return triples.select(sample, F.col("feature").cast("long"), value).unionByName(ones)


def stacked(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Sparse sources one below the other: each part's features below its limit, shifted by the limits before it."""
    out, offset = None, 0
    for df, limit in parts:
        own = df.where((F.col("feature") >= 0) & (F.col("feature") < limit)).withColumn("feature", (F.col("feature") + offset).cast("long"))
        out, offset = own if out is None else out.unionByName(own), offset + limit
    return out


def zipped(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Two aligned sources side by side; refuses sources of different keys."""
    both = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), on, "full")
    if both.where("__l is null or __r is null").limit(1).count():
        raise ValueError("the sources do not hold the same samples")
    return both.drop("__l", "__r")


def hashed_share(key: Column, share: float, buckets: int = 1000) -> Column:
    """A fixed pseudo-random subset of keys, by whole-number arithmetic that any engine repeats. The key is brought below
    2**31 first, so that no product leaves 64 bits; the rest is the same."""
    return F.pmod(F.pmod(key, F.lit(2147483648)) * F.lit(1103515245) + F.lit(12345), F.lit(2147483648)) % buckets < int(share * buckets)


def blend(a: DataFrame, b: DataFrame, key: str, share: float) -> DataFrame:
    """The given share of a's rows and the complement's share of b's."""
    return a.where(hashed_share(F.col(key), share)).unionByName(b.where(~hashed_share(F.col(key), share)))


def blend_runs(a: DataFrame, b: DataFrame, place: str, block: int, share: float, keep_a: float = 1.0, keep_b: float = 1.0) -> DataFrame:
    """Runs of `block` rows, by place: a hash of the run's number says whether it comes from a (with the given share) or from
    b, another whether it is taken at all."""
    run = F.floor(F.col(place) / block).cast("long")
    from_a = hashed_share(run, share)
    return a.where(from_a & hashed_share(run + 104729, keep_a)).unionByName(b.where(~from_a & hashed_share(run + 224737, keep_b)))


def sparse(df: DataFrame, row: str, col: str, value: Column) -> DataFrame:
    """(row, col, value) with duplicates added up."""
    return df.groupBy(row, col).agg(F.sum(value).alias("value"))


def full(triples: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Every (row, col) of two key tables, zero where there is no triple. The grid is the result's own size."""
    grid = rows.crossJoin(cols)
    return grid.join(triples, grid.columns, "left").withColumn("value", F.coalesce("value", F.lit(0)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def renumbered(triples: DataFrame, feature: str = "feature") -> DataFrame:
    """Features numbered by falling number of occurrences, ties by old number."""
    n = triples.groupBy(feature).agg(F.count("*").alias("__c"))
    ids = rank_by_count(n, "__c", (feature,), "new_feature").select(feature, "new_feature")
    return triples.join(ids, feature)
