import duckdb
import pytest

import __spark_entry__ as entry
from readalike.llm.oracle import ORACLE
from readalike.llm.queries import registered

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2": "doc_id contaminated", "op3": "doc_id class_id kept", "op4": "page_id url text n_chars",
    "op5": "doc_id size source_size target taken", "op6": "doc_id held_out score predicted",
    "op7": "page_id host path rule verdict", "op8": "doc_id n_bytes n_tokens over_limit", "op9": "slot doc_id",
    "op10": "page_id payload_bytes payload_digest record_type refers_to",
    "op11": "doc_id n_shingles component_id", "op12": "word form root n n_near form_n",
    "op13": "vec_id component n deviation whitened explained identity_error"}
KEYS = {"op4": ("pages", "page_id"), "op7": ("pages", "page_id"), "op10": ("pages", "page_id"), "op13": ("embeddings", "vec_id")}
ROWS = {"op9": None, "op13": 4}
WITHOUT_IDS = {"op12"}  # its rows are words, see test_spelling


def test_all_are_registered():
    assert {name.split("_")[0] for name in registered()} == COLUMNS.keys()
    assert registered().keys() | {"pipeline"} <= entry.queries().keys()
    assert ORACLE.keys() <= entry.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(registered()))
def test_query_returns_its_columns_over_the_whole_table(spark, name):
    out = registered()[name](spark, SF)
    op = name.split("_")[0]
    assert set(COLUMNS[op].split()) <= set(out.columns)
    if op in WITHOUT_IDS:
        return
    name, key = KEYS.get(op, ("documents", "doc_id"))
    whole = spark.read.parquet(f"{SF}/{name}.parquet")
    ids = {r[0] for r in whole.select(key).collect()}
    found = [r[0] for r in out.select(key).collect()]
    assert set(found) == ids and len(found) == (ROWS.get(op, 1) or len(found) / len(ids)) * len(ids)


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_query_equals_its_sql(spark, name, folder):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cursor = con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    found = registered()[name](spark, folder)
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(cursor.fetchall())
