"""Every registered query against its SQL text on the smallest tables."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, CHECKS = registry.QUERIES, registry.CHECKS  # those of gridfolio.llm have tests of their own


#: where a query finds nothing on the smallest tables, these decide
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    """One DuckDB per folder, with a view per table."""
    made = {}
    for folder in (SF, LARGER):
        made[folder] = duckdb.connect()
        for t in TABLES:
            made[folder].execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return made


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, (dt.datetime, dt.date)):
        return value.strftime("%Y-%m-%d")
    if isinstance(value, (bool, int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.10g}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert name in CHECKS, f"{name} has no SQL check"
    for folder in (SF, LARGER):
        cursor = duck[folder].execute(CHECKS[name])
        names, want = [d[0] for d in cursor.description], cursor.fetchall()
        if want:
            break
    assert want, f"{name} finds nothing, so nothing is compared"
    result = QUERIES[name](spark, folder)
    assert sorted(result.columns) == sorted(names)
    assert rows_of(result.columns, [tuple(r) for r in result.collect()]) == rows_of(names, want)
