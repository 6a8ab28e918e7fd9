"""Every core query runs on the smallest data, and equals its SQL."""

import glob
import math
import os

import duckdb
import pytest

from tarnweave.plans import registry, sql


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def show(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.6g}" if isinstance(v, float) else str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)
    return sorted(columns), sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", registry.NAMES)
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    text = sql.oracle_sql().get(name)
    if text is not None:
        cursor = duck.execute(text)
        wanted = canonical([c[0] for c in cursor.description], cursor.fetchall())
        assert got == wanted


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(sql.oracle_sql()) <= set(entry.queries())
