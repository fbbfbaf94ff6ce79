"""Every query against its DuckDB counterpart over the smallest tables; the others must run."""

import math

import duckdb
import pytest

from sievelight.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = df.collect()
    sql = registry.oracle_sql().get(name)
    if not sql:
        assert got or name == "replay_matches"  # nothing happens near in time in so few events
        return
    r = duck.sql(sql)
    cols = list(r.columns)
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(norm(v) for v in (row[cols.index(c)] for c in sorted(cols))) for row in r.fetchall()), key=str)
    mine = sorted((tuple(norm(row[c]) for c in sorted(cols)) for row in got), key=str)
    assert len(mine) == len(want)
    for a, b in zip(mine, want, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-5, abs_tol=1e-5) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "verdict" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
