"""Every registered query of the library against its DuckDB twin, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from sessionlake.plans import archive_catalog, catalog  # noqa: F401  registers queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    def cell(v):
        if isinstance(v, (list, tuple)) or v is None or pd.isna(v):
            return str(v) if isinstance(v, (list, tuple)) else None
        if isinstance(v, (bool, str)):
            return str(v)
        return round(float(v), 6) if not hasattr(v, "isoformat") else str(pd.Timestamp(v))

    return sorted(([cell(v) for v in r] for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str), sorted(df.columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert rows(got) == rows(want)
