"""What the operators of this subpackage share: reading tables, cutting lineage, running code over Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of characters other than space and the five ASCII line and tab controls.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII characters between words.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one only on a local master that names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="tallyforge-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/tallyforge/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table under the shared folder and reads it back: its lineage ends there, and a lost
    executor costs a re-read, not a recomputation. The tables stay until the folder is cleaned."""
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives back what memory it no longer needs when it ends: Python workers are kept for later tasks, and
    would otherwise hold the most that any task ever took."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library is GNU's
            if trim:
                trim(0)

    return f


def over_batches(df: DataFrame, schema: T.StructType | str, make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]]) -> DataFrame:
    """mapInArrow with per-task state: make() runs once in a task and returns what turns a batch into columns."""
    spark_schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = spark_schema.fieldNames()

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for part in small(b):
                out = f(part)
                yield pa.RecordBatch.from_arrays([out[n] for n in names], names=names)

    return df.mapInArrow(run, spark_schema)


def small(batch: pa.RecordBatch, rows: int = 512, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices without copying, of at most `rows` rows and about `most` bytes of text (more only for one long text), so
    that what is made of a slice stays small."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for name in ("text", "__text"):
        if name in batch.schema.names:
            sizes += pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        begin = int(ends[at - 1]) if at else 0
        stop = min(max(int(np.searchsorted(ends, begin + most, side="right")), at + 1), at + rows)
        yield batch.slice(at, stop - at)
        at = stop


def n_words(text):
    """Number of words of a string column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_size(text):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def let(value, f):
    """f applied to value, which is evaluated once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)
