"""Records of named features, each a list of bytes, of floats or of whole numbers, in protocol-buffer wire format.

A record is field 1 (the features), whose entries, field 1 each, are a name (1) and a feature (2) of one kind: bytes (1),
floats (2) or whole numbers (3), values packed or not."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources import files

FEATURES = "map<string, struct<bytes: array<binary>, floats: array<float>, ints: array<bigint>>>"


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, value) of a message's fields."""
    at = 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _read_varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None and kind != 2:
                raise ValueError(f"wire type {kind} in a record")
            if size is None:
                size, at = _read_varint(data, at)
            if at + size > len(data):
                raise ValueError("a record ends inside a field")
            value, at = data[at : at + size], at + size
        yield tag >> 3, kind, value


def encode(features: dict[str, dict[str, list] | None]) -> bytes:
    """Bytes of a record; of a feature's lists (bytes, floats, ints) the first that is there is written."""
    out = []
    for name, f in features.items():
        body = b""
        if f and f.get("bytes") is not None:
            body = _field(1, b"".join(_field(1, bytes(v)) for v in f["bytes"]))
        elif f and f.get("floats") is not None:
            body = _field(2, _field(1, struct.pack(f"<{len(f['floats'])}f", *f["floats"])))
        elif f and f.get("ints") is not None:
            body = _field(3, _field(1, b"".join(_varint(v) for v in f["ints"])))
        out.append(_field(1, _field(1, name.encode()) + _field(2, body)))
    return _field(1, b"".join(out))


def _values(kind: int, data: bytes) -> list:
    out: list = []
    for number, wire, v in _fields(data):
        if number != 1:
            continue
        if kind == 1:
            out.append(v)
        elif kind == 2:
            out += struct.unpack(f"<{len(v) // 4}f", v)
        elif wire == 0:
            out.append(v)
        else:
            at = 0
            while at < len(v):
                n, at = _read_varint(v, at)
                out.append(n)
    return [n - (1 << 64) if n >> 63 else n for n in out] if kind == 3 else out


def decode(data: bytes) -> dict[str, dict[str, list]]:
    """Features of a record by name; a name that comes again replaces the one before."""
    out: dict[str, dict[str, list]] = {}
    entries = (e for n, _, body in _fields(data) if n == 1 for m, _, e in _fields(body) if m == 1)
    for entry in entries:
        parts = {n: v for n, _, v in _fields(entry)}
        feature = {"bytes": None, "floats": None, "ints": None}
        for kind, _, body in _fields(parts.get(2, b"")):
            if kind in (1, 2, 3):
                feature[("bytes", "floats", "ints")[kind - 1]] = _values(kind, body)
        out[parts.get(1, b"").decode()] = feature
    return out


def feature(values: Column, kind: str) -> Column:
    """An entry's value from an array column: kind is bytes, floats or ints."""
    types = {"bytes": "array<binary>", "floats": "array<float>", "ints": "array<bigint>"}
    return F.struct(*[(values if k == kind else F.lit(None)).cast(t).alias(k) for k, t in types.items()])


def write_examples(df: DataFrame, features: dict[str, Column], path: str) -> int:
    """Framed record files, one a partition, of the named features; returns the number of records."""
    entries = F.create_map(*[c for name, f in features.items() for c in (F.lit(name), f)])
    return files.write_framed(df.select(entries.alias("features")), path, "tfrecord", lambda rows: files.frame_records([encode(dict(r[0])) for r in rows]))


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, features) of framed record files."""

    def run(batches):
        import pyarrow as pa

        kinds = pa.struct([("bytes", pa.list_(pa.binary())), ("floats", pa.list_(pa.float32())), ("ints", pa.list_(pa.int64()))])
        for b in batches:
            features = [list(decode(r).items()) for r in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(features, pa.map_(pa.string(), kinds))], names=["path", "place", "features"])

    return files.read_records(spark, path).mapInArrow(run, f"path string, place bigint, features {FEATURES}")
