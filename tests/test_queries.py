"""Every query with SQL agrees with DuckDB on the smallest tables; the others run."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from strandloom.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 9)
    return str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    found = QUERIES[name](spark, sf)
    rows = [r.asDict() for r in found.collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    wanted = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    as_text = lambda rows: sorted(repr([_plain(r[c]) for c in sorted(columns)]) for r in rows)
    assert as_text(rows) == as_text(wanted)
