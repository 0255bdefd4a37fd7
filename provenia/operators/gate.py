"""The evidence gate: a quote counts only where the document has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.functions.text import WHITE, collapse, find_quote, let, page_for_offset, slice_text
from provenia.operators import matching


def verify_span(text: Column, start: Column, end: Column, quote: Column, pages: Column | None = None) -> Column:
    """(mode, start, end, page, verified) of a quote claimed to stand at start..end of text.

    exact: it does. normalized: but for white space. relocated: it stands elsewhere, and
    the span is moved there. not_found: nowhere, which is never evidence. A null text is
    a document that is not known.
    """
    said = F.trim(F.coalesce(quote, F.lit("")))

    def ladder(at: Column) -> Column:
        found = find_quote(text, said)
        return (
            F.when(text.isNull() | (said == ""), F.struct(F.lit("not_found").alias("mode"), start.alias("start"), end.alias("end")))
            .when(at == said, F.struct(F.lit("exact").alias("mode"), start.alias("start"), end.alias("end")))
            .when((collapse(at) == collapse(said)) & (collapse(said) != ""), F.struct(F.lit("normalized").alias("mode"), start.alias("start"), end.alias("end")))
            .otherwise(let(found, lambda f: F.when(f >= 0, F.struct(F.lit("relocated").alias("mode"), f.alias("start"), (f + F.length(said)).alias("end"))).otherwise(F.struct(F.lit("not_found").alias("mode"), start.alias("start"), end.alias("end")))))
        )

    def whole(v: Column) -> Column:
        good = v["mode"] != "not_found"
        page = F.when(good, page_for_offset(pages, v["start"])) if pages is not None else F.lit(None).cast("int")
        return F.struct(v["mode"].alias("mode"), v["start"].alias("start"), v["end"].alias("end"), page.alias("page"), good.alias("verified"))

    return let(let(slice_text(text, start, end), ladder), whole)


def verify_all(candidates: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates (doc_id, start, end, quote) with their verification; those that pass, and the others.

    Documents (doc_id, text, pages) that are not known drop their candidates.
    """
    joined = candidates.join(docs.select("doc_id", F.col("text").alias("_text"), F.col("pages").alias("_pages")), "doc_id", "left")
    checked = joined.withColumn("match", verify_span(F.col("_text"), F.col("start"), F.col("end"), F.col("quote"), F.col("_pages"))).drop("_text", "_pages")
    return checked.where("match.verified"), checked.where("not match.verified")


def quotes_in_documents(quotes: DataFrame, docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(quote_id, doc_id, start[, quote, text]) for each document that has a quote, where none is claimed.

    quotes (quote_id, quote), docs (doc_id, text). start is what find_quote() gives: a quote
    counts in any case and with any white space between its words. Quotes of HELD characters
    in all go into one automaton, with which each text is read once. More are looked up by
    their words. Null quotes and such without words are nowhere, null texts have none.
    """
    sought = quotes.where(F.trim(F.regexp_replace("quote", WHITE, " ")) != "").select("quote_id", "quote")
    size = sought.agg(F.sum(F.length("quote")).alias("n")).first()["n"] or 0
    if size > matching.HELD:
        return _by_words(sought, docs, with_text)
    held = [(r["quote_id"], r["quote"]) for r in sought.collect()]
    kind = sought.schema["quote_id"].dataType.simpleString()
    numbered = docs.sparkSession.createDataFrame([(k, i, q) for k, (i, q) in enumerate(held)], f"number int, quote_id {kind}, quote string")
    found = matching.quotes_by_automaton(held, docs, with_text).join(F.broadcast(numbered), "number")
    return found.select("quote_id", "doc_id", "start", *(["quote", "text"] if with_text else []))


def _folded(text: Column) -> Column:
    """text in one case, in which all that find_quote() takes for equal is equal (and some more is)."""
    return F.upper(F.lower(F.translate(text, "\u0130\u0131", "ii")))


def _by_words(quotes: DataFrame, docs: DataFrame, with_text: bool) -> DataFrame:
    """quotes_in_documents() for any number of quotes, without empty ones.

    A quote of three words or more is looked up by its longest inner word among the
    documents' words, one of two by its first word's end and its last word's beginning, a
    single word by itself as a part of the documents' distinct words; only documents that
    have these are searched.
    """
    words = F.split(F.trim(F.regexp_replace(_folded(F.col("quote")), WHITE, " ")), " ")
    parted = quotes.select("quote_id", words.alias("w"))
    inner = F.expr("element_at(array_sort(slice(w, 2, size(w) - 2), (a, b) -> CASE WHEN length(a) <> length(b) THEN length(b) - length(a) WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END), 1)")
    anchored = parted.where(F.size("w") >= 3).select("quote_id", inner.alias("word"))
    needed = anchored.select("word").distinct()
    tokens = docs.select("doc_id", F.explode(F.array_distinct(F.split(_folded(F.col("text")), WHITE))).alias("word"))
    pairs = tokens.join(F.broadcast(needed), "word", "left_semi") if _few(needed) else tokens.join(needed, "word", "left_semi")
    near = pairs.join(anchored, "word").select("quote_id", "doc_id").distinct()
    short = parted.where(F.size("w") < 3).select("quote_id", "w")
    if not short.isEmpty():
        near = near.unionByName(_with_short_quotes(short, tokens)).distinct()
    found = near.join(docs.select("doc_id", "text"), "doc_id").join(quotes, "quote_id").select("quote_id", "doc_id", find_quote(F.col("text"), F.col("quote")).alias("start"), "quote", "text").where("start >= 0")
    return found if with_text else found.drop("quote", "text")


def _with_short_quotes(short: DataFrame, tokens: DataFrame) -> DataFrame:
    """(quote_id, doc_id) of documents that can have quotes of one or two words (w).

    The documents' words are looked at once each, whatever number of documents has them:
    a word ends with the first of two words, or has the only one, if one of its pieces of
    the quote's length is it; so both sides meet by equality.
    """
    heads = short.select("quote_id", F.try_element_at("w", F.lit(1)).alias("piece"), (F.size("w") == 2).alias("two"))
    sizes = heads.select(F.length("piece").alias("n"), "two").distinct()
    each = tokens.select("word").distinct().join(F.broadcast(sizes), F.col("n") <= F.length("word"))
    last = F.length("word") - F.col("n")
    starts = F.when(F.col("two"), F.array(last)).otherwise(F.sequence(F.lit(0), last))
    pieces = each.select("word", "n", "two", F.explode(starts).alias("k")).select("word", "two", F.expr("substring(word, k + 1, n)").alias("piece")).distinct()
    meet = pieces.join(heads, ["piece", "two"]).select("word", "quote_id")
    return tokens.join(meet, "word").select("quote_id", "doc_id").distinct()


def _few(df: DataFrame, most: int = 100_000) -> bool:
    return df.limit(most + 1).count() <= most
