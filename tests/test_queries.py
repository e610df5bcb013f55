"""Every registered query of the curve operators against its SQL on the small tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from wavelens import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        return v.item() if isinstance(v, np.generic) else v

    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = db.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    for a, b in zip(rows(got), rows(want), strict=True):
        assert a == pytest.approx(b) if all(isinstance(v, (int, float)) for v in a) else a == b
