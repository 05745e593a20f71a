"""Every registered query of the coreset operators against its SQL, on the given tables."""

import os

import duckdb
import pytest

from corepick.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def run_sql(sql):
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con.execute(sql).df()


def rows(df):
    cols = sorted(df.columns)
    text = lambda v: f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    assert len(got)
    if sql:
        want = run_sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        a, b = rows(got), rows(want)
        assert len(a) == len(b)
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        assert not bad, (len(bad), bad[:3])
