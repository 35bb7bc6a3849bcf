"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from rasterloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    return sorted((tuple("null" if x is None or x is pd.NA or x != x else x.item() if hasattr(x, "item") else x for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.toPandas()
    assert len(got)
    if name in catalog.ORACLE_SQL:
        want = db.sql(catalog.ORACLE_SQL[name])
        assert dict(zip(want.columns, map(str, want.types), strict=True)) == {c: KINDS[k] for c, k in df.dtypes}
        assert plain(got) == plain(want.df())
