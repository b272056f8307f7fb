"""Queries with SQL beside them, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from flowlens.llm import workload

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = list(workload.QUERIES)
    assert [next(n for n in names if n.startswith(f"op{k}_")) for k in range(1, 14)] and "pipeline" in names
    assert set(workload.QUERIES) <= set(entry.queries()) and set(workload.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(workload.ORACLE))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    want = con.execute(workload.ORACLE[name])
    columns = sorted(d[0] for d in want.description)
    rows = [dict(zip([d[0] for d in want.description], r, strict=True)) for r in want.fetchall()]
    found = workload.QUERIES[name](spark, FOLDER)
    assert sorted(found.columns) == columns
    assert sorted(str([r[c] for c in columns]) for r in found.collect()) == sorted(str([r[c] for c in columns]) for r in rows)
