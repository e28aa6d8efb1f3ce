"""Queries with an SQL twin, over the awkward rows."""

from __future__ import annotations

import collections

import duckdb
import pytest

from tallyforge.llm import catalog
from tests.llm import helpers


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_twin(spark, tmp_path, name):
    docs = helpers.docs(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    value = lambda x: f"{x:.6g}" if isinstance(x, float) else str(x)
    df = catalog.queries()[name](spark, str(tmp_path))
    got = collections.Counter(tuple(value(r[c]) for c in sorted(df.columns)) for r in df.collect())
    result = con.execute(catalog.oracles()[name])
    names = [c[0] for c in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == sorted(df.columns)
    assert got == collections.Counter(tuple(value(row[i]) for i in order) for row in result.fetchall())


def test_every_operator_has_one_query():
    names = [n for n in catalog.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
