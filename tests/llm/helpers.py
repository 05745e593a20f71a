"""Side by side comparison of a query and its SQL over small tables."""

import os

import duckdb
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def run_sql(sql: str, folder: str = SF) -> pd.DataFrame:
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        if f.endswith(".parquet"):
            path = f"{folder}/{f}" if os.path.isfile(f"{folder}/{f}") else f"{folder}/{f}/*.parquet"
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{path}'")
    return con.execute(sql).df()


def same_rows(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    key = lambda d: sorted(tuple(str(v) if not isinstance(v, float) else f"{v:.9g}" for v in r) for r in d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False))
    left, right = key(a), key(b)
    assert len(left) == len(right), (len(left), len(right))
    bad = [(x, y) for x, y in zip(left, right) if x != y]
    assert not bad, bad[:3]
