"""Registered queries against their SQL on small tables of odd rows."""

import duckdb
import pytest
from test_queries import plain

from provenia.plans import registry


def same(spark, folder, name, **tables):
    """The rows of a query over tables (rows, schema), once they are held against its SQL."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    got = registry.QUERIES[name](spark, str(folder))
    want = con.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    a = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    b = sorted(tuple(map(plain, r)) for r in want.fetchall())
    assert a == b
    return a


_DOCS = ("doc_id long, text string", "item_id long, text string")


def test_only_quotes_that_stand_as_they_are(spark, tmp_path):
    docs = [(1, "Say one\ntwo three."), (2, "ONE TWO THREE"), (3, "one  two three"), (4, "x\none two three\none two three")]
    tables = {"documents": (docs, _DOCS[0]), "benchmark": ([(7, "one two three"), (8, "two three.")], _DOCS[1])}
    gate = same(spark, tmp_path, "evidence_gate", **tables)
    assert len(gate) == 8  # quote 8 in document 1 and quote 7 in document 4, four claims each
    assert len(same(spark, tmp_path, "quote_lines", **tables)) == 2


def test_a_brand_in_capitals_letter_by_letter(spark, tmp_path):
    docs = [(1, "Erßung enver"), (2, "ﬁrma zwei"), (3, "Straße " + "w " * 70), (4, " Acme is"), (5, "")]
    got = same(spark, tmp_path, "brand_authority", documents=(docs, _DOCS[0]))
    assert sum("MFR_DATASHEET" in r for r in got) == 3


def test_a_short_quote_with_a_line_break_is_nowhere(spark, tmp_path):
    talk = ([(1, 1, "say Cio.\nQue now"), (1, 2, "cio.  que"), (2, 1, "one que"), (2, 2, "Que")], "conv_id long, turn int, text string")
    marks = ([(1, "one Cio.\nQue now"), (2, "Cio. que")], "item_id long, text string")
    got = same(spark, tmp_path, "short_quotes", conversations=talk, benchmark=marks)
    assert not any("\n" in q for r in got for q in r)


_PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


@pytest.mark.parametrize("name", ["extract_from_doc", "naive_arm", "llm_prompts"])
def test_sheets_of_any_number_of_parts(spark, tmp_path, name):
    parts = [(k, "steel" if k % 2 else f"rod{k}", "Brand#1", ("PROMO", "ECONOMY", "SMALL")[k % 3], 7, 900.0 + k) for k in range(150)]
    assert len(same(spark, tmp_path, name, part=(parts, _PART))) >= 300


def test_series_tables_of_any_number_of_parts(spark, tmp_path):
    lines = [(1, k, 1.0 + k % 50, 100.25 + k, 0.05) for k in range(120)] + [(2, 7, 3.0, 10.5, 0.1), (2, 9, 50.0, 11.0, 0.02), (3, 1, 4.0, 9.0, 0.0)]
    got = same(spark, tmp_path, "series_table", lineitem=(lines, "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double"))
    assert sum("PRICE" in r for r in got) == 122
