"""Compare a query's rows with those of SQL in DuckDB."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def rows(frame: pd.DataFrame) -> list[str]:
    columns = sorted(frame.columns)
    plain = lambda x: None if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and np.isnan(x) else float(x) if isinstance(x, (int, float, np.integer, np.floating)) and not isinstance(x, bool) else str(x)
    return sorted(str(tuple(map(plain, r))) for r in frame[columns].itertuples(index=False, name=None))


def assert_same(spark, query, sql: str, folder: str = SMALL) -> None:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    got, want = query(spark, folder).toPandas(), db.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
