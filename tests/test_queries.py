"""Every catalogue query against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from gridloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(str(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(db.execute(catalogue.SQL[name]).df())
