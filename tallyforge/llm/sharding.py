"""Contiguous shards of near-equal byte size, cut from global prefix sums.

Only (key, size, crc) rows move: they are range-partitioned by key, each partition adds up its own sizes in
order, the per-partition totals (one row a partition) give each partition its offset, and a row's shard follows
from the middle of its byte range. Texts are never shuffled, a hot source or text plays no part in the keys, and
repeated rows are spread by a salt, since rows that are alike in every sorted column may stand in any order.

Defined cases: a null or empty text has no bytes; a very long text is one row of its size; a null key sorts first; ties and
repeated rows get slots of their own; an empty table gives an empty result; further columns, whatever their names, are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import cut, utf8_size

#: Bytes that a row costs besides its text.
ROW_OVERHEAD = 16

_LOCAL = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("text_crc32", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("row_in_part", T.LongType()),
        T.StructField("bytes_before", T.LongType()),
    ]
)


def _local_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's place and the bytes before it in its partition; carries both from batch to batch."""
    rows = total = 0
    for b in batches:
        size = b.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
        before = total + np.cumsum(size) - size
        place = rows + np.arange(len(size), dtype=np.int64)
        rows, total = rows + len(size), total + int(size.sum())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("size"), b.column("text_crc32"), b.column("part"), pa.array(place), pa.array(before)], names=_LOCAL.fieldNames())


def shard_by_bytes(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard (0 to shards-1), slot (gapless in its shard).

    Shards are contiguous in key order and hold near-equal bytes: a row goes to the shard that holds the middle
    of its byte range, so no shard is off its target by more than one row at either end."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (utf8_size(F.col(text)) + ROW_OVERHEAD).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(F.monotonically_increasing_id(), F.lit(4096)).alias("salt"),
    )
    ordered = narrow.repartitionByRange(n, "doc_id", "text_crc32", "size", "salt").sortWithinPartitions("doc_id", "text_crc32", "size")
    local = ordered.select("doc_id", "size", "text_crc32", F.spark_partition_id().alias("part")).mapInArrow(_local_sums, _LOCAL)
    local = cut(local, "shard-sums")
    totals = local.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("b")).orderBy("part").collect()  # a row a partition
    offsets, rows, total = [], 0, 0
    for r in totals:
        offsets.append((r["part"], rows, total))
        rows, total = rows + r["n"], total + r["b"]
    offset = spark.createDataFrame(offsets, "part int, rows_before long, part_bytes_before long")
    placed = local.join(F.broadcast(offset), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("rows_before") + F.col("row_in_part")).alias("place"),
        (F.col("part_bytes_before") + F.col("bytes_before")).alias("before"),
    )
    middle = (2 * F.col("before") + F.col("size")) * F.lit(shards)
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), _div(middle, 2 * max(total, 1))).cast("int"))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # as many rows as shards
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def _div(a, b: int):
    """Whole-number division of a non-negative long."""
    return F.call_function("div", a, F.lit(b).cast("long"))
