"""Each query of the subpackage over whole tables: against its SQL, or for one row of each document."""

import os

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

from bramble.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in sorted(f.removesuffix(".parquet") for f in os.listdir(SF)):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name in ORACLE_SQL:
        want = tables.sql(ORACLE_SQL[name]).to_arrow_table()
        names = sorted(want.column_names)
        assert sorted(got.column_names) == names
        rows = [sorted(map(repr, zip(*(t[c].to_pylist() for c in names), strict=True))) for t in (got, want)]
        assert rows[0] == rows[1]
        return
    ids = [r[0] for r in tables.sql("SELECT doc_id FROM documents").fetchall()]
    assert sorted(set(got["doc_id"].to_pylist())) == sorted(ids)
    assert name == "op4_packing" or got.num_rows == len(ids)
