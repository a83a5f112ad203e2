"""Every query with SQL gives what DuckDB gives on the same tables."""

import os
from pathlib import Path

import duckdb
import pytest

from cytolake.queries import ORACLE, QUERIES

D = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(D).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple("-" if (v := r[i]) is None else f"{v + 0.0:.5f}" if isinstance(v, float) else str(v) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, D)
    want = duck.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    want = _rows(columns, want.fetchall())
    got = _rows(df.columns, df.collect())
    assert want, "nothing to compare"
    assert len(got) == len(want)
    differ = [(a, b) for a, b in zip(got, want) if a != b]
    assert not differ, differ[:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_models_run(spark, name):
    df = QUERIES[name](spark, D)
    assert df.columns and df.count() > 0
