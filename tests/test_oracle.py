"""Every registered query with SQL against DuckDB, as the driver compares them."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DIR}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    # whole numbers of a column with nulls come as floats from one side and as integers from the other
    clean = lambda v: None if v is None or v is pd.NA or v != v else int(v) if isinstance(v, float) and v.is_integer() else round(v, 6) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v.item() if hasattr(v, "item") else v
    return sorted(([clean(v) for v in r] for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    want = duck.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, DIR).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(n for n in set(entry.queries()) - set(entry.oracle_sql()) if not n.startswith("op") and n != "pipeline"))
def test_runs(spark, name):
    assert entry.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
