"""File sources and sinks: numbered files, date paths, matrix files, record files, model directories."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode_date(year: Column, month: Column, day: Column, hour: Column | None = None) -> Column:
    """A day number with months of 31 days; with an hour, an hour number."""
    n = 372 * year + 31 * month + day
    return n if hour is None else n * 24 + hour


def decode_date(n: Column) -> tuple[Column, Column, Column]:
    """Year, month, day of a day number."""
    rest = n - 32
    year = F.floor(rest / 372)
    inside = rest - 372 * year
    month = F.floor(inside / 31)
    return year, month + 1, inside - 31 * month + 1


def numbered(spark: SparkSession, pattern: str, first: int, last: int | None = None) -> list[str]:
    """Paths pattern % n for n in [first, last); without last, those from the first file on up to the first gap, found by
    listing the folder once (the pattern's number stands in the last part of the path)."""
    if last is not None:
        return [pattern % n for n in range(first, last)]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern % first)
    folder = path.getParent()
    names = {s.getPath().getName() for s in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)}
    leaf = pattern.rsplit("/", 1)[1]
    there = sorted(n for n in {int(d) for x in names for d in re.findall(r"[0-9]+", x)} if n >= first and leaf % n in names)
    if not there:
        raise FileNotFoundError(f"no file matches {pattern}")
    found = [there[0]]
    for n in there[1:]:
        if n != found[-1] + 1:
            break
        found.append(n)
    return [pattern % n for n in found]


def read_numbered(spark: SparkSession, pattern: str, first: int, last: int | None = None, order: int = 0, seed: int = 0) -> DataFrame:
    """Rows of numbered Parquet files with their file's place; order 0 as numbered, 1 permuted by seed."""
    paths = numbered(spark, pattern, first, last)
    if order == 1:
        import random

        random.Random(seed).shuffle(paths)
    out = None
    for i, p in enumerate(paths):
        df = spark.read.parquet(p).withColumn("file_no", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return out


def write_blocks(df: DataFrame, path: str, rows: int = 100_000) -> None:
    """Parquet files of at most `rows` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def save_model(path: str, options: dict, **matrices: DataFrame) -> None:
    """A model directory: options as JSON, each matrix as a Parquet table."""
    first = next(iter(matrices.values()))
    first.sparkSession.createDataFrame([(json.dumps(options),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/options")
    for name, df in matrices.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, *names: str) -> tuple[dict, dict[str, DataFrame]]:
    options = json.loads("".join(r[0] for r in spark.read.text(f"{path}/options").collect()))
    return options, {n: spark.read.parquet(f"{path}/{n}") for n in names}


def delete_model(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Checkpoints:
    """Versions of a model under one path; the last `keep` stay."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep, self.versions = spark, path, keep, []

    def save(self, version: int, options: dict, **matrices: DataFrame) -> None:
        save_model(f"{self.path}/v{version:06d}", options, **matrices)
        self.versions.append(version)
        while len(self.versions) > self.keep:
            delete_model(self.spark, f"{self.path}/v{self.versions.pop(0):06d}")

    def load(self, *names: str) -> tuple[dict, dict[str, DataFrame]]:
        return load_model(self.spark, f"{self.path}/v{self.versions[-1]:06d}", *names)


def _crc32c_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return table


_CRC32C = _crc32c_table()


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC32C[(c ^ b) & 0xFF] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    """The rotated and shifted checksum that record files store."""
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame_records(records: list[bytes]) -> bytes:
    """Records framed by length and masked checksums."""
    out = []
    for r in records:
        head = struct.pack("<Q", len(r))
        out += [head, struct.pack("<I", masked(crc32c(head))), r, struct.pack("<I", masked(crc32c(r)))]
    return b"".join(out)


def records(data: bytes) -> Iterator[bytes]:
    """The records of framed bytes; a broken checksum raises."""
    at = 0
    while at < len(data):
        head = data[at : at + 8]
        (n,) = struct.unpack("<Q", head)
        if struct.unpack("<I", data[at + 8 : at + 12])[0] != masked(crc32c(head)):
            raise ValueError("broken record length")
        body = data[at + 12 : at + 12 + n]
        if struct.unpack("<I", data[at + 12 + n : at + 16 + n])[0] != masked(crc32c(body)):
            raise ValueError("broken record")
        yield body
        at += 16 + n


def write_framed(df: DataFrame, path: str, suffix: str, frame: Callable[[list], bytes], head: Callable[[int], bytes] | None = None) -> int:
    """Binary files under a path that driver and executors share, one a partition; returns the number of rows. frame turns
    the rows of a batch (tuples) into bytes, head the number of rows into what stands first. A file is written under a
    name of its attempt and moved when it is whole, so a task run again leaves one file."""

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        system.create_dir(base, recursive=True)
        name, n = f"{base}/_{uuid.uuid4().hex}", 0
        with system.open_output_stream(name) as out:
            for b in batches:
                out.write(frame(list(zip(*[c.to_pylist() for c in b.columns]))))
                n += b.num_rows
        if head is not None:
            with system.open_output_stream(f"{name}-whole") as out, system.open_input_stream(name) as body:
                out.write(head(n))
                while part := body.read(1 << 20):
                    out.write(part)
            system.delete_file(name)
            name += "-whole"
        system.move(name, f"{base}/part-{TaskContext.get().partitionId():06d}.{suffix}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return df.mapInArrow(run, "n long").agg({"n": "sum"}).first()[0] or 0


def write_named(df: DataFrame, path: str, suffix: str) -> int:
    """A binary file for each row (n, data), named by its number, under a path that driver and executors share; returns how
    many. A file is written under a name of its attempt and moved when it is whole."""

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        system.create_dir(base, recursive=True)
        for b in batches:
            for n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name = f"{base}/_{uuid.uuid4().hex}"
                with system.open_output_stream(name, compression=None) as out:
                    out.write(data)
                system.move(name, f"{base}/part-{n:08d}.{suffix}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return df.select("n", "data").mapInArrow(run, "n long").agg({"n": "sum"}).first()[0] or 0


def write_records(df: DataFrame, record: str, path: str) -> int:
    """Record files of a binary column; null records are left out."""
    return write_framed(df.select(record).where(F.col(record).isNotNull()), path, "tfrecord", lambda rows: frame_records([bytes(r[0]) for r in rows]))


def write_binary_vectors(df: DataFrame, word: str, vector: str, size: int, path: str) -> int:
    """Word vectors as binary files: a line with the number of words and of coordinates, then for each word its text, a space,
    and its coordinates in single precision, lowest byte first."""
    import numpy as np

    frame = lambda rows: b"".join(w.encode() + b" " + np.array(v, "<f4").tobytes() + b"\n" for w, v in rows)
    rows = df.select(F.col(word).cast("string"), F.col(vector).cast("array<float>"))
    return write_framed(rows, path, "bin", frame, lambda n: f"{n} {size}\n".encode())


def read_binary_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) of binary vector files; a file may hold no words. A worker holds one file's bytes and the vectors of
    4,096 words at a time."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for content in b.column(0):
                data = content.as_py()
                at = data.index(b"\n") + 1
                n, size = map(int, data[:at].split())
                for first in range(0, n, 4096):
                    words, vectors = [], []
                    for _ in range(first, min(first + 4096, n)):
                        end = data.index(b" ", at)
                        words.append(data[at:end].lstrip(b"\n").decode())
                        vectors.append(np.frombuffer(data, "<f4", size, end + 1))
                        at = end + 1 + 4 * size
                    offsets = np.arange(len(words) + 1, dtype=np.int32) * size
                    rows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(vectors), pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), rows], names=["word", "vector"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "word string, vector array<float>")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, record) of record files."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("place", T.LongType()), T.StructField("record", T.BinaryType())])

    def run(parts):
        import pandas as pd

        for pdf in parts:
            for p, content in zip(pdf["path"], pdf["content"]):
                rows = list(records(bytes(content)))
                yield pd.DataFrame({"path": [p] * len(rows), "place": range(len(rows)), "record": rows})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)
