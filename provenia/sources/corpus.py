"""Documents, parts and pages as DataFrames, and what a corpus keeps about its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenia.functions.text import strip_html


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below path that begin with %PDF, with their SHA-256; their text is decoded elsewhere."""
    files = spark.read.format("binaryFile").load(path)
    good = files.where(F.substring("content", 1, 4) == F.lit(b"%PDF"))
    return good.select("path", "length", F.sha2("content", 256).alias("sha256"))


def document_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text, pages) from page rows (doc_id, page, text[, width, height]).

    Texts are joined in page order; a page's span is what comes before it plus its length.
    """
    before = F.sum(F.length("text")).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)).cast("int")
    placed = pages.withColumn("char_start", start).withColumn("char_end", (start + F.length("text")).cast("int"))
    row = F.struct("page", "char_start", "char_end", "text")
    grouped = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("p"))
    return grouped.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), F.transform("p", lambda x: F.struct(x["page"].alias("page"), x["char_start"].alias("char_start"), x["char_end"].alias("char_end"))).alias("pages"))


def page_spans(pages: DataFrame) -> DataFrame:
    """(doc_id, page, char_start, char_end) for each page row; nothing but lengths is shuffled."""
    sized = pages.select("doc_id", "page", F.length("text").alias("n"))
    end = F.sum("n").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    return sized.select("doc_id", "page", (end - F.col("n")).alias("char_start"), end.alias("char_end"))


def stale(found: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (doc_id, sha256) for which the cache has no text of the same digest."""
    return found.join(cache, ["doc_id", "sha256"], "left_anti")


def write_text_cache(texts: DataFrame, path: str) -> None:
    """Append decoded texts (doc_id, sha256 of the file, text) to the cache at path."""
    texts.select("doc_id", "sha256", "text").write.mode("append").parquet(path)


def through_cache(found: DataFrame, decoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, sha256, text, from_cache) of files found (doc_id, sha256).

    Where the cache has a text of the same digest that is taken; the others come from
    decoded (doc_id, sha256, text); write_text_cache() of those with from_cache false adds them.
    """
    cache = found.sparkSession.read.parquet(path).dropDuplicates(["doc_id", "sha256"])
    new = decoded.join(stale(found, cache), ["doc_id", "sha256"], "left_semi").select("doc_id", "sha256", "text")
    old = cache.join(found, ["doc_id", "sha256"], "left_semi").select("doc_id", "sha256", "text")
    return old.withColumn("from_cache", F.lit(True)).unionByName(new.withColumn("from_cache", F.lit(False)))


def revisions(lock: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, previous, sha256, revised): whether a document's digest differs from its lock entry."""
    old = lock.select("doc_id", F.col("sha256").alias("previous"))
    return found.join(old, "doc_id", "left").select("doc_id", "previous", "sha256", F.coalesce(F.col("previous") != F.col("sha256"), F.lit(False)).alias("revised"))


def load_documents(manifest: DataFrame, fetched: DataFrame, lock: DataFrame) -> DataFrame:
    """Manifest rows with their digest, from the lock else as computed; one never fetched raises an error when read."""
    own = fetched.select("doc_id", F.col("sha256").alias("computed"))
    known = lock.select("doc_id", F.col("sha256").alias("locked"), "fetched_at")
    joined = manifest.join(own, "doc_id", "left").join(known, "doc_id", "left")
    digest = F.coalesce("locked", "computed")
    checked = F.when(F.col("computed").isNull(), F.raise_error(F.concat(F.col("doc_id"), F.lit(" has not been fetched"))).cast("string")).otherwise(digest)
    return joined.withColumn("sha256", checked).drop("locked", "computed")


def bridge(manifest: DataFrame) -> DataFrame:
    """(part, doc_id, doc_pos): which documents cover a part, in manifest order; parts upper case and trimmed."""
    each = manifest.select("doc_id", "doc_pos", F.explode("covers").alias("part"))
    return each.select(F.upper(F.trim("part")).alias("part"), "doc_id", "doc_pos")


def docs_for_part(skus: DataFrame, manifest: DataFrame) -> DataFrame:
    return skus.withColumn("part", F.upper(F.trim("mpn"))).join(bridge(manifest), "part")


def known_parts(skus: DataFrame, manifest: DataFrame) -> DataFrame:
    """(part): all parts of the catalog and of documents, upper case."""
    return skus.select(F.upper("mpn").alias("part")).union(bridge(manifest).select("part")).distinct()


def brand_matches(publisher: Column, brand: Column) -> Column:
    """Whether either, in letters alone, begins with the first six of the other."""
    letters = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]", "")
    p, b = letters(publisher), letters(brand)
    return (p != "") & (b != "") & (F.startswith(p, F.left(b, F.lit(6))) | F.startswith(b, F.left(p, F.lit(6))))


def catalog_rows(spark: SparkSession, path: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a headed CSV file of parts whose maker is not excluded; all columns are texts."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return rows.where(~F.coalesce(F.trim("Part_Manuf"), F.lit("")).isin(*excluded)) if excluded else rows


def malformed_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a headed CSV file that have too few or too many fields, with what could be read and the line in `_line`."""
    names = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in [*names, "_line"])
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("columnNameOfCorruptRecord", "_line").schema(schema).csv(path)
    return rows.where(F.col("_line").isNotNull())


def _gold_records(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    """(value, v): the records of a file of labels as they stand and as variants, null where they are no JSON."""
    text = spark.read.option("wholetext", whole).text(path)
    return text.where(F.trim("value") != "").select("value", F.try_parse_json("value").alias("v"))


def gold_labels(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(sku, attribute, accepted) from labels; accepted is an array of (num, str, flag).

    A line is the record of one part, {"sku": ..., "labels": {attribute: value or list}}, so
    files of any size are read by many tasks. whole: files that are one small JSON text
    each, {"labels": {sku: {attribute: value or list}}}. Records that are neither are left
    to gold_errors().
    """
    records = _gold_records(spark, path, whole)
    of = lambda rows, v, *names: rows.lateralJoin(spark.tvf.variant_explode(v.outer())).select(*names, F.col("key"), F.col("value").alias("of"))
    if whole:
        by_sku = of(records.select(F.try_variant_get("v", "$.labels", "variant").alias("v")), F.col("v"))
        by_sku = by_sku.select(F.col("key").alias("sku"), F.col("of").alias("labels"))
    else:
        by_sku = records.select(F.try_variant_get("v", "$.sku", "string").alias("sku"), F.try_variant_get("v", "$.labels", "variant").alias("labels")).where("sku is not null")
    each = of(by_sku, F.col("labels"), "sku").where("key is not null").select("sku", F.col("key").alias("attribute"), "of")
    several = F.try_variant_get("of", "$", "array<string>")
    values = F.when(F.schema_of_variant("of").startswith("ARRAY"), several).otherwise(F.array(F.try_variant_get("of", "$", "string")))
    flag = lambda v: F.when(v.isin("true", "false"), v == "true")
    one = lambda v: F.struct(v.try_cast("double").alias("num"), F.when(v.try_cast("double").isNull() & flag(v).isNull(), v).alias("str"), flag(v).alias("flag"))
    return each.select("sku", "attribute", F.transform(values, one).alias("accepted"))


def gold_errors(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(value, reason) of the records that gold_labels() cannot read."""
    records = _gold_records(spark, path, whole)
    key = F.lit(True) if whole else F.try_variant_get("v", "$.sku", "string").isNotNull()
    labels = F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.labels", "variant")).startswith("OBJECT"), F.lit(False))
    reason = F.when(F.col("v").isNull(), "no JSON").when(~key, "no sku").when(~labels, "no labels")
    return records.select("value", reason.alias("reason")).where("reason is not null")


def fetched_pages(responses: DataFrame) -> DataFrame:
    """(…, ok, text, reason) of recorded HTTP responses (url, status, content_type, body, error).

    A failure or a status of 400 or more is not ok; HTML loses its tags; PDF is refused;
    any other text is cut at 200,000 characters, as a page is.
    """
    kind = F.coalesce("content_type", F.lit(""))
    failed, html, pdf = F.coalesce("error", F.lit("")) != "", kind.contains("text/html"), kind.contains("pdf")
    bad = F.col("status") >= 400
    return responses.withColumns(
        {
            "ok": ~failed & ~F.coalesce(bad, F.lit(True)) & (html | ~pdf),
            "text": F.when(failed | F.coalesce(bad, F.lit(True)), "").when(html, strip_html(F.col("body"))).when(pdf, "").otherwise(F.left("body", F.lit(200_000))),
            "reason": F.when(failed, F.col("error")).when(bad, F.concat(F.lit("HTTP "), F.col("status"))).when(~html & pdf, "PDF asset (not text-extracted)").otherwise(""),
        }
    )


# Words of a specification.
_SPECIFIED = r"(?i)\b(voltage|amperage|dimensions|specifications|dBA|cu\.?\s*ft)\b"


def has_content(text: Column, mpn: Column) -> Column:
    """Whether a page names the part or has a word of a specification."""
    return F.upper(text).contains(F.upper(mpn)) | text.rlike(_SPECIFIED)


def first_reachable(pages: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the first page, in order of url_pos, that is ok, longer than 200 and has content; else the last failure.

    pages: keys, mpn, url_pos and the columns of fetched_pages().
    """
    real = has_content(F.col("text"), F.col("mpn"))
    good = F.col("ok") & (F.length("text") > 200) & real
    empty = F.col("ok") & (F.length("text") > 200) & ~real
    row = F.struct("url", good.alias("ok"), "status", "text", F.when(empty, "page has no product content").otherwise(F.col("reason")).alias("reason"))
    best = pages.groupBy(*keys).agg(F.min_by(F.when(good, row), F.when(good, F.col("url_pos"))).alias("hit"), F.max_by(row, "url_pos").alias("last"))
    return best.select(*keys, F.coalesce("hit", "last").alias("x")).select(*keys, "x.*")


def candidate_urls(rows: DataFrame, search: dict[str, str]) -> DataFrame:
    """(…, url_pos, url): where to look for a part (mpn, brand_key, domain), the support search first."""
    searches = F.create_map(*[F.lit(x) for pair in search.items() for x in pair])
    support = F.try_element_at(searches, F.col("brand_key"))
    urls = F.array(F.concat(support, F.col("mpn")), F.concat(F.lit("https://"), F.col("domain"), F.lit("/en/p/owner-center/product-support/"), F.col("mpn")), F.concat(F.lit("https://"), F.col("domain"), F.lit("/search?q="), F.col("mpn")))
    return rows.select("*", F.posexplode(F.filter(urls, lambda u: u.isNotNull())).alias("url_pos", "url"))


def redirect_target(href: Column) -> Column:
    """The address a search result leads to."""
    wrapped = F.regexp_extract(href, r"uddg=([^&]+)", 1)
    return F.when(wrapped != "", F.url_decode(wrapped)).when(href.startswith("http"), href).otherwise(F.concat(F.lit("https:"), href))


def host(url: Column) -> Column:
    return F.lower(F.element_at(F.split(F.regexp_replace(url, "^https?://", ""), "/"), 1))


def domain_token(domain: Column) -> Column:
    """The last label but one of a host name."""
    labels = F.split(domain, r"\.")
    return F.when(F.size(labels) >= 2, F.element_at(labels, -2)).otherwise(domain)


def brand_of_results(results: DataFrame, brands: DataFrame) -> DataFrame:
    """(mpn, brand_key, url) for the first search result (mpn, rank, href) on a known maker's domain.

    A host's labels but its last are looked up among the brands' own, so the join is an
    equality and any number of results and brands will do.
    """
    to = redirect_target(F.col("href"))
    labels = F.split(host(to), r"\.")
    each = results.select("mpn", "rank", to.alias("url"), F.posexplode(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0)))).alias("pos", "token"))
    own = brands.select("brand_key", domain_token(F.col("domain")).alias("token"))
    return each.join(own, "token").groupBy("mpn").agg(F.min_by(F.struct("brand_key", "url"), F.struct("rank", "pos", "brand_key")).alias("x")).select("mpn", "x.*")
