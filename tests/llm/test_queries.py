"""The registered queries on the smallest tables: beside their SQL, or with the rows and columns they promise."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pairweave.llm import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")

ROWS = {  # table whose rows the result has, and its columns
    "op1_html_text": ("pages", "page_id url text n_chars"),
    "op2_language_id": ("documents", "doc_id held_out lang_pred score"),
    "op3_decontamination": (None, "doc_id item_id score first_word last_word"),
    "op6_toxicity": ("documents", "doc_id held_out score predicted"),
    "op7_token_store": ("documents", "doc_id start n_tokens ids_crc32"),
    "op8_importance_resampling": ("documents", "doc_id held_out n_grams log_weight rank_value selected"),
    "pipeline": (None, "doc_id start n_tokens ids_crc32"),
}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return con


def cells(df):
    df = df[sorted(df.columns)].convert_dtypes(convert_string=False, convert_boolean=False)  # nullable integers alike
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


def test_every_operator_is_registered_once():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} == set(queries.ORACLES) | set(ROWS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    got, want = entry.queries()[name](spark, SF_DIR).toPandas(), db.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


@pytest.mark.parametrize("name", sorted(ROWS))
def test_query_has_its_rows(spark, db, name):
    table, columns = ROWS[name]
    got = entry.queries()[name](spark, SF_DIR)
    assert got.columns == columns.split()
    rows = got.collect()
    if table:
        key = got.columns[0]
        assert sorted(r[key] for r in rows) == [x[0] for x in db.execute(f"select {key} from {table} order by 1").fetchall()]
