"""Every registered query with SQL gives DuckDB's rows."""

import math
from pathlib import Path

import duckdb
import pytest

from callweave import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        return float(v) if type(v).__name__ == "Decimal" else v

    return sorted([tuple((v is None, str(one(v) if not isinstance(v, int) or isinstance(v, bool) else float(v))) for v in r) for r in rows])


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = plain(tuple(r[c] for c in names) for r in got.collect())
    order = [want.columns.index(c) for c in names]
    expected = plain(tuple(r[i] for i in order) for r in want.fetchall())
    assert rows == expected
    assert rows


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
