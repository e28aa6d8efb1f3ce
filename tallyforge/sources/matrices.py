"""Binary matrix files: four 32-bit numbers (a code, rows, columns, stored values), then the matrix by columns.

The code's hundreds say dense (1) or sparse (2), its tens the kind of the values. A dense file holds the values of its
columns one after the other; a sparse one where each column begins, the row of each stored value, and the values. All
numbers stand lowest byte first; a name that ends in .gz is compressed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources import files

#: The tens of the code, and the kind of number that each stands for.
KINDS = {0: "<i1", 1: "<i4", 2: "<i8", 3: "<f4", 4: "<f8"}


def dense_bytes(columns: list, rows: int, kind: int = 3) -> bytes:
    """A dense matrix of columns of `rows` values each."""
    import numpy as np

    body = np.asarray(columns, KINDS[kind]).reshape(len(columns), rows)
    return np.array([100 + 10 * kind, rows, len(columns), 0], "<i4").tobytes() + body.tobytes()


def sparse_bytes(columns: list[list[tuple[int, float]]], rows: int, kind: int = 3) -> bytes:
    """A sparse matrix of columns of (row, value), rows rising."""
    import numpy as np

    starts = np.concatenate([[0], np.cumsum([len(c) for c in columns])])
    cells = [x for c in columns for x in c]
    head = np.array([200 + 10 * kind + 1, rows, len(columns), len(cells)], "<i4")
    return head.tobytes() + starts.astype("<i4").tobytes() + np.array([r for r, _ in cells], "<i4").tobytes() + np.array([v for _, v in cells], KINDS[kind]).tobytes()


def cells(data: bytes):
    """(row, column, value) arrays of a matrix file's bytes; of a dense one every cell, of a sparse one those stored."""
    import numpy as np

    code, rows, cols, stored = (int(x) for x in np.frombuffer(data, "<i4", 4))
    kind = code // 10 % 10
    if kind not in KINDS or code // 100 not in (1, 2):
        raise ValueError(f"a matrix file of code {code}")
    if code // 100 == 1:
        return np.tile(np.arange(rows), cols), np.repeat(np.arange(cols), rows), np.frombuffer(data, KINDS[kind], rows * cols, 16)
    at = 16 + 4 * (cols + 1)
    starts = np.frombuffer(data, "<i4", cols + 1, 16)
    return np.frombuffer(data, "<i4", stored, at), np.repeat(np.arange(cols), np.diff(starts)), np.frombuffer(data, KINDS[kind], stored, at + 4 * stored)


def write_matrix(df: DataFrame, rows: int, path: str, columns_per_file: int, kind: int = 3, compressed: bool = False) -> int:
    """Matrix files of a table (col, cells), cells an array of (row, value) structs: file n holds the columns from
    n * columns_per_file on, empty ones where the table has none (columns at the end that it lacks are left out). One worker
    holds a file's columns, so that columns_per_file bounds memory. Returns the number of files."""
    suffix = "smat.gz" if compressed else "smat"
    block = F.floor(F.col("col") / columns_per_file)
    grouped = df.select(block.alias("n"), (F.col("col") - block * columns_per_file).cast("int").alias("c"), "cells")

    def pack(key, frame):
        import gzip

        import pandas as pd

        width = int(frame["c"].max()) + 1
        columns: list[list] = [[] for _ in range(width)]
        for c, cs in zip(frame["c"], frame["cells"]):
            columns[c] = sorted((int(x["row"]), x["value"]) for x in cs)
        data = sparse_bytes(columns, rows, kind)
        return pd.DataFrame({"n": [key[0]], "data": [gzip.compress(data) if compressed else data]})

    packed = grouped.groupBy("n").applyInPandas(pack, "n bigint, data binary")
    return files.write_named(packed, path, suffix)


def read_matrix(spark: SparkSession, path: str, columns_per_file: int) -> DataFrame:
    """(row, col, value) of the matrix files under a path, numbered as write_matrix numbers them."""

    def run(batches):
        import gzip
        import re

        import pyarrow as pa

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                first = int(re.findall(r"[0-9]+", name.rsplit("/", 1)[1])[0]) * columns_per_file
                r, c, v = cells(gzip.decompress(content) if name.endswith(".gz") else content)
                for at in range(0, len(v), 1 << 16):
                    cut = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(r[cut], pa.int64()), pa.array(c[cut] + first, pa.int64()), pa.array(v[cut].astype("f8"))], names=["row", "col", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "row bigint, col bigint, value double")
