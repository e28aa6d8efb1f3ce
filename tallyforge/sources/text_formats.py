"""Readers of text formats as column expressions over lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column types of a format specification and the Spark types they become.
SPEC_TYPES = {"int": "int", "dint": "bigint", "qhex": "string", "float": "float", "double": "double", "word": "string", "string": "string", "date": "timestamp", "mdate": "timestamp", "cmdate": "timestamp", "dt": "date", "mdt": "date", "group": "array<int>", "igroup": "array<int>", "digroup": "array<bigint>"}

#: How date columns are written.
DATE_FORMATS = {"date": "yyyy-MM-dd HH:mm:ss", "mdate": "MM/dd/yyyy HH:mm:ss", "cmdate": "MM/dd/yy HH:mm:ss", "dt": "yyyy-MM-dd", "mdt": "MM-dd-yyyy"}


@dataclass(frozen=True)
class Field:
    kind: str
    name: str


def parse_spec(text: str) -> list[Field]:
    """Fields of a format specification: a type and a name on each line."""
    return [Field(*line.split()[:2]) for line in text.splitlines() if line.strip()]


def typed(part: Column, f: Field, inner: str = ",") -> Column:
    """A delimited part as its type; null where it does not parse."""
    if f.kind in DATE_FORMATS:
        clean = F.regexp_replace(part, "[-/:T]", " ")
        pattern = DATE_FORMATS[f.kind].translate(str.maketrans("-/:", "   "))
        stamp = F.try_to_timestamp(clean, F.lit(pattern))
        return stamp if SPEC_TYPES[f.kind] == "timestamp" else stamp.cast("date")
    if f.kind in ("group", "igroup", "digroup"):
        return F.transform(F.split(part, inner), lambda x: x.try_cast("bigint" if f.kind == "digroup" else "int"))
    if f.kind == "string":
        return F.split(part, inner)
    return part.try_cast(SPEC_TYPES[f.kind])


def read_delimited(lines: DataFrame, spec: list[Field], delimiter: str = "\t", column: str = "value") -> DataFrame:
    """Rows of delimited lines by a format specification; lines with too few fields are skipped."""
    parts = F.split(F.col(column), delimiter, -1)
    return lines.where(F.size(parts) >= len(spec)).select(*[typed(F.get(parts, F.lit(i)), f).alias(f.name) for i, f in enumerate(spec)])


def read_namespaces(lines: DataFrame, column: str = "value", key: str = "id") -> DataFrame:
    """(id, label, namespace, name, value) of lines "label |namespace name[:value] ..."; a missing value is 1."""
    blocks = F.split(F.col(column), r"\|")
    head = lines.select(key, F.get(blocks, F.lit(0)).alias("__label"), F.posexplode(F.slice(blocks, 2, 1_000_000)).alias("__b", "__block"))
    words = F.filter(F.split("__block", " "), lambda x: x != "")
    items = head.select(key, F.trim("__label").try_cast("double").alias("label"), F.get(words, F.lit(0)).alias("namespace"), F.explode(F.slice(words, 2, 1_000_000)).alias("__item"))
    pair = F.split("__item", ":")
    return items.select(key, "label", "namespace", F.get(pair, F.lit(0)).alias("name"), F.coalesce(F.get(pair, F.lit(1)).try_cast("double"), F.lit(1.0)).alias("value"))


def read_vectors(lines: DataFrame, column: str = "value") -> DataFrame:
    """(word, vector) of lines "word x1 x2 ..."."""
    parts = F.split(F.trim(F.col(column)), " ")
    return lines.select(F.get(parts, F.lit(0)).alias("word"), F.transform(F.slice(parts, 2, 1_000_000), lambda x: x.cast("double")).alias("vector"))


def write_vectors(df: DataFrame, word: str, vector: str) -> DataFrame:
    """Lines of the same form, one string column `value`."""
    return df.select(F.concat_ws(" ", F.col(word).cast("string"), F.transform(vector, lambda x: x.cast("string"))).alias("value"))


def read_clicks(lines: DataFrame, ints: int = 13, hexes: int = 26, column: str = "value") -> DataFrame:
    """label, i1.., c1.. and `present` (a flag for each field) of tab-separated click logs with hexadecimal categories."""
    parts = F.split(F.col(column), "\t", -1)
    at = lambda i: F.get(parts, F.lit(i))
    cols = [at(0).try_cast("int").alias("label")]
    cols += [at(1 + i).try_cast("int").alias(f"i{i + 1}") for i in range(ints)]
    cols += [F.conv(F.nullif(at(1 + ints + i), F.lit("")), 16, 10).cast("bigint").alias(f"c{i + 1}") for i in range(hexes)]
    present = F.transform(F.slice(parts, 2, ints + hexes), lambda x: (x != "").cast("int"))
    return lines.select(*cols, present.alias("present"))


def segments(df: DataFrame, order: str, blank: Column) -> DataFrame:
    """Adds record: the number of blank rows before a row; blank rows themselves are dropped."""
    from tallyforge.operators.ordering import running_sums

    return running_sums(df, (order,), blank.cast("int"), "record").where(~blank)


MATRIX = T.StructType([T.StructField("row", T.LongType()), T.StructField("col", T.LongType()), T.StructField("value", T.DoubleType())])
