"""Every registered query of the corpus operators on the smallest tables: with SQL its rows, else its columns and rows."""

import duckdb
import pytest
from tests.test_queries import rows

from tallyloom.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"query_id", "rank", "vec_id", "score"}, "op2": {"doc_id", "n_shingles", "component_id"}, "op3": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op4": {"doc_id", "held_out", "score", "predicted"}, "op5": {"doc_id", "n_bytes", "n_tokens", "over_limit"}, "op6": {"doc_id"}, "op7": {"doc_id", "held_out", "score", "predicted"},
    "op8": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}, "op9": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op10": {"doc_id", "start", "n_tokens", "ids_crc32"},
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_whole_table(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    operator = name.split("_")[0]
    assert COLUMNS[operator] <= set(got.columns)
    if operator == "op1":
        assert (got.groupby("query_id").size() == 10).all()
        return
    documents = duck.execute("SELECT doc_id FROM documents").df()
    assert set(got.doc_id) == set(documents.doc_id)
    assert operator == "op8" or len(got) == len(documents)
