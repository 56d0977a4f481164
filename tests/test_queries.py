"""Every registered query against its SQL on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PANEL = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no sample tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if Path(DIR, f"{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is None, str(v) if not isinstance(v, float) else "", round(v, 4) if isinstance(v, float) else 0) for v in row)


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", PANEL)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DIR)
    columns = sorted(got.columns)
    ours = sorted(([norm(r[c]) for c in columns] for r in got.collect()), key=key)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(([norm(r[names.index(c)]) for c in columns] for r in cursor.fetchall()), key=key)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and x == pytest.approx(y, rel=1e-6, abs=2e-6)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
