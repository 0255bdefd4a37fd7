"""Table functions for SQL: what generators find, as rows.

``register(spark)`` makes them known to one session. Each takes a table, may be given it
``PARTITION BY (columns)``, and says by itself what columns it returns.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from provenia.operators.matching import all_places, automaton, chain, fold


def _shape(table: AnalyzeArgument, needed: dict[str, str], found: list[tuple[str, object]]) -> AnalyzeResult:
    """The table's columns but its text, and those that are found; an error that names what is missing."""
    if not table.isTable:
        raise ValueError("the first argument must be a table, TABLE(...)")
    kinds = {f.name: f.dataType.simpleString() for f in table.dataType.fields}
    for name, kind in needed.items():
        if kinds.get(name) != kind:
            raise ValueError(f"the table must have a column {name} of type {kind}")
    kept = [f for f in table.dataType.fields if f.name not in needed]
    clash = {f.name for f in kept} & {name for name, _ in found}
    if clash:
        raise ValueError(f"the table has columns that the function returns: {sorted(clash)}")
    return AnalyzeResult(StructType([*kept, *(StructField(name, kind) for name, kind in found)]))


class WordPlaces:
    """word_places(TABLE(docs), words): a row (word, s, e) for each place of each word in each row's text, in any case.

    words is a constant list. All other columns of the table come along. A null text has no places.
    """

    def __init__(self):
        self.sought = None

    @staticmethod
    def analyze(table: AnalyzeArgument, words: AnalyzeArgument) -> AnalyzeResult:
        if words.isTable or not isinstance(words.dataType, ArrayType) or not words.isConstantExpression:
            raise ValueError("the second argument must be a constant array of strings")
        return _shape(table, {"text": "string"}, [("word", StringType()), ("s", IntegerType()), ("e", IntegerType())])

    def eval(self, row, words) -> Iterator[tuple]:
        if self.sought is None:
            self.asked: dict[str, list[str]] = {}
            for w in filter(None, words):
                self.asked.setdefault(fold(w), []).append(w)
            self.sought = automaton({w: w for w in self.asked}) or False
        if row["text"] is None or not self.sought:
            return
        kept = tuple(v for k, v in row.asDict(recursive=False).items() if k != "text")
        for folded, places in all_places(row["text"], self.sought).items():
            for word in self.asked[folded]:
                yield from ((*kept, word, s, e) for s, e in places)


class SeriesHeaders:
    """series_headers(TABLE(docs), gap): a row (s, e) for each place in a row's text where its siblings follow each other.

    The table has text and siblings, an array of words; a gap between two is at most `gap` characters.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        return _shape(table, {"text": "string", "siblings": "array<string>"}, [("s", IntegerType()), ("e", IntegerType())])

    def eval(self, row, gap) -> Iterator[tuple]:
        kin = [fold(w or "") for w in row["siblings"] or ()]
        if row["text"] is None or len(kin) < 2 or not all(kin):
            return
        found = all_places(row["text"], automaton({w: w for w in kin}))
        kept = tuple(v for k, v in row.asDict(recursive=False).items() if k not in ("text", "siblings"))
        yield from ((*kept, s, e) for s, e in chain([found.get(w, []) for w in kin], gap))


def register(spark: SparkSession) -> None:
    """Make the table functions known to this session, and to no other."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("word_places", udtf(WordPlaces))
    spark.udtf.register("series_headers", udtf(SeriesHeaders))
