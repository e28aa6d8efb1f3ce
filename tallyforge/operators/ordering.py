"""Global order without a sort or a window in one task: rows are range-partitioned by all order columns, sorted within
their partition and written once with their partition and place; what comes before a partition is a sum over a table
of a row a partition. Rows with equal first columns are split by the others, so no key's rows need fit one task. The
written table keeps places fixed, whatever is computed from it and however often a task is run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.scratch import kept

MARK, PART = "__mark", "__part"


def placed(df: DataFrame, order: tuple[str | Column, ...]) -> DataFrame:
    """df in order, with MARK (rising in that order) and PART, the number of the key range a row is in."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    marked = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn(MARK, F.monotonically_increasing_id())
    return kept(marked, "ordered").withColumn(PART, F.shiftright(MARK, 33))


def _with_offsets(df: DataFrame, total: Column) -> DataFrame:
    """Adds __before: the sum of `total` over the ranges before a row's own (at most as many rows as ranges)."""
    sums = df.groupBy(PART).agg(total.alias("__t"))
    before = sums.select(PART, (F.sum("__t").over(Window.orderBy(PART)) - F.col("__t")).alias("__before"))
    return df.join(F.broadcast(before), PART)


def row_numbers(df: DataFrame, order: tuple[str | Column, ...], name: str) -> DataFrame:
    """Adds the place, from 0, of each row in the order of `order`."""
    r = _with_offsets(placed(df, order), F.count("*"))
    place = F.col(MARK).bitwiseAND(F.lit((1 << 33) - 1))
    return r.withColumn(name, (F.col("__before") + place).cast("long")).drop(PART, MARK, "__before")


def running_sums(df: DataFrame, order: tuple[str | Column, ...], value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over all rows up to each row in the order of `order`."""
    r = _with_offsets(placed(df.withColumn("__v", value), order), F.sum("__v"))
    upto = F.sum("__v").over(Window.partitionBy(PART).orderBy(MARK).rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn(name, F.col("__before") + upto).drop(PART, MARK, "__before", "__v")


def running_max(df: DataFrame, order: tuple[str | Column, ...], value: str, name: str) -> DataFrame:
    """Adds the largest `value` of all rows up to each row in the order of `order`."""
    r = placed(df, order)
    tops = r.groupBy(PART).agg(F.max(value).alias("__t"))
    before = tops.select(PART, F.max("__t").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    upto = F.max(value).over(Window.partitionBy(PART).orderBy(MARK).rowsBetween(Window.unboundedPreceding, 0))
    return r.join(F.broadcast(before), PART).withColumn(name, F.greatest("__before", upto)).drop(PART, MARK, "__before")


def rank_by_count(df: DataFrame, count: str, ties: tuple[str, ...], name: str) -> DataFrame:
    """Adds places from 0 by falling count, ties in the order of `ties`. Words of one count, half a vocabulary, are split
    by the ties."""
    return row_numbers(df, (F.desc(count), *ties), name)
