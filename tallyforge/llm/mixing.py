"""Mixing sources to target weights by repetition rates.

Token totals per source give each source's target and so its repetition rate; a document is then emitted
floor(rate) times, plus once more if a hash of it, read as a number in [0, 1), lies below the fraction. The totals
are partial sums before any shuffle, the table of sources is broadcast only after it was counted, and beyond that
size the join is salted, so that a source with a third of all rows is spread over many tasks.

Defined cases: a null text has size 0; a null source is a source of its own and comes last; a source without words
has target and rate 0 and is not emitted; very long texts count whole; further columns, whatever their names, are kept
by `mix` and not read; rows that repeat are mixed independently only if they differ in key or text; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, n_words

#: Sources up to this number are broadcast (a few MB); more are joined with salt.
BROADCAST_SOURCES = 50_000
SALTS = 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size, target of a table (source, size).

    Sources in code point order (null last) weigh `weights`, repeating. Targets share the total by weight; one that
    would pass `most` times its source's size stops there and its excess is shared among the rest by weight, until
    none is above. With the sources ordered by the level (target per weight) at which they fill up, the filled ones
    are a prefix: the common level of the others is what is left of the total by what is left of the weights, and
    source i fills up if that level, computed as if all before it were filled, reaches its own."""
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    t = t.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(most))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = (
        t.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level_here", (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
        .withColumn("full", F.col("level_here") * F.col("weight") >= F.col("cap"))
        .withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "level_here"))).over(everything)["level_here"])
    )
    return t.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def copies(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, doc_key, source, size, source_size, target, copies: how often the mix takes each document.

    doc_key is a digest of key and text; documents with equal keys and texts get the same number."""
    narrow = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        doc_key(F.col(key), F.col(text)).alias("doc_key"),
        F.col(source).cast("string").alias("source"),
        n_words(F.col(text)).alias("size"),
    )
    narrow = cut(narrow, "mix-sizes")
    targets = cut(source_targets(narrow, weights, most), "mix-targets")
    joined = _join_sources(narrow, targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    times = copies_of(rate, draw(F.col("doc_key"), seed))
    return joined.select("doc_id", "doc_key", "source", "size", "source_size", "target", times.alias("copies"))


def doc_key(key, text):
    return F.md5(F.concat_ws(":", key.cast("string"), F.md5(text)))


def _join_sources(narrow: DataFrame, targets: DataFrame) -> DataFrame:
    t = targets.withColumnRenamed("source", "target_source")
    same = F.col("source").eqNullSafe(F.col("target_source"))
    if t.count() <= BROADCAST_SOURCES:
        return narrow.join(F.broadcast(t), same).drop("target_source")
    t = t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    n = narrow.withColumn("doc_salt", F.pmod(F.xxhash64("doc_key"), F.lit(SALTS)).cast("int"))
    return n.join(t, same & (F.col("doc_salt") == F.col("salt"))).drop("target_source", "salt", "doc_salt")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs. No text is shuffled: a row's rate is
    looked up by its source and its draw is taken from its own digest."""
    narrow = docs.select(F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"))
    targets = cut(source_targets(narrow, weights, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = targets.select(F.col("source").alias("target_source"), rate.alias("__rate"))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(source).cast("string").alias("__source"), draw(doc_key(F.col(key), F.col(text)), seed).alias("__draw"))
    same = F.col("__source").eqNullSafe(F.col("target_source"))
    if rates.count() <= BROADCAST_SOURCES:
        joined = marked.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = F.pmod(F.floor(F.col("__draw") * 1048576), F.lit(SALTS)).cast("int")
        joined = marked.withColumn("__own", own).join(salted, same & (F.col("__own") == F.col("__salt")))
    times = copies_of(F.col("__rate"), F.col("__draw"))
    return joined.withColumn("__times", times).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select("__row.*")


def draw(digest, seed: int):
    """A number in [0, 1) from a digest and a seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), digest)), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def copies_of(rate, d):
    """The whole part of the rate, and one more where the draw lies below its fraction."""
    return (F.floor(rate) + (d < rate - F.floor(rate)).cast("long")).cast("long")
