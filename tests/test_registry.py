"""Every registered query runs and equals its SQL on the smallest tables."""

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from pairweave.plans import catalog, oracles  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return con


def cells(df):
    df = df[sorted(df.columns)].convert_dtypes(convert_string=False, convert_boolean=False)  # nullable integers alike
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_entry_lists_every_query_and_its_sql():
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(catalog.QUERIES) == set(oracles.ORACLES)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    assert len(got)
    want = db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)
