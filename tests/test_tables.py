"""Table functions called by SQL."""

import pytest
from pyspark.errors import PySparkException

from provenia.functions import tables

ROWS = [(1, "VF at IF, vf max", ["A1", "B2"]), (2, "a1 B2 x A1 - b2", ["A1", "B2"]), (3, None, None), (4, "", ["A1"])]


@pytest.fixture
def docs(spark):
    tables.register(spark)
    spark.createDataFrame(ROWS, "doc_id int, text string, siblings array<string>").createOrReplaceTempView("docs")
    return spark


def test_places_of_words_by_sql(docs):
    got = docs.sql("SELECT doc_id, word, s, e FROM word_places(TABLE(SELECT doc_id, text FROM docs) PARTITION BY (doc_id), array('VF', 'if', 'a1'))")
    assert sorted(map(tuple, got.collect())) == [(1, "VF", 0, 2), (1, "VF", 10, 12), (1, "if", 6, 8), (2, "a1", 0, 2), (2, "a1", 8, 10)]
    assert docs.sql("SELECT * FROM word_places(TABLE(docs), array('nowhere'))").columns == ["doc_id", "siblings", "word", "s", "e"]
    assert docs.sql("SELECT * FROM word_places(TABLE(docs), CAST(array() AS array<string>))").count() == 0


def test_headers_by_sql(docs):
    got = docs.sql("SELECT * FROM series_headers(TABLE(docs), 5)")
    assert sorted(map(tuple, got.collect())) == [(2, 0, 5), (2, 8, 15)]


def test_wrong_tables_are_told_so(docs):
    for query, why in (("TABLE(SELECT 1 AS text), array('a')", "column text of type string"), ("TABLE(SELECT 'a' AS text, 1 AS s), array('a')", "columns that the function returns"), ("TABLE(docs), 'a'", "constant array")):
        with pytest.raises(PySparkException, match=why):
            docs.sql(f"SELECT * FROM word_places({query})").count()


def test_functions_belong_to_their_session(docs):
    with pytest.raises(PySparkException):
        docs.newSession().sql("SELECT * FROM word_places(TABLE(SELECT 'a' AS text), array('a'))").count()
