"""The appliance batch: rows of a catalog file to delivered rows and a review log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia.operators import delivery
from provenia.sources import corpus, reference, sinks


def input_rows(spark: SparkSession, path: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the catalog file whose maker is not excluded and whose description names a category."""
    rows = corpus.catalog_rows(spark, path, excluded)
    return rows.where(delivery.classify(F.col("Part_Desc")).isNotNull())


def wanted_urls(rows: DataFrame, searched: DataFrame | None = None) -> DataFrame:
    """(mpn, brand_key, url_pos, url): the pages to be fetched for each row, in the order to try them."""
    keyed = rows.select(F.col("Mfg_Part_Num").alias("mpn"), delivery.brand_key(F.col("Part_Desc")).alias("named"))
    if searched is not None:
        keyed = keyed.join(searched.select("mpn", F.col("brand_key").alias("found")), "mpn", "left")
    else:
        keyed = keyed.withColumn("found", F.lit(None).cast("string"))
    branded = keyed.select("mpn", F.coalesce("named", "found").alias("brand_key")).join(F.broadcast(reference.brands(rows.sparkSession)), "brand_key")
    return corpus.candidate_urls(branded, reference.SUPPORT_SEARCH).select("mpn", "brand_key", "url_pos", "url")


def run(rows: DataFrame, fetched: DataFrame, responses: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Delivered rows from recorded pages (mpn, url_pos, url, status, content_type, body, error),
    model responses (mpn, label, found, value, quote) and search results (mpn, rank, href)."""
    searched = corpus.brand_of_results(results, reference.brands(rows.sparkSession)) if results is not None else None
    best = corpus.first_reachable(corpus.fetched_pages(fetched), ["mpn"])
    category = rows.select(F.col("Mfg_Part_Num").alias("mpn"), delivery.classify(F.col("Part_Desc")).alias("category"))
    found = delivery.page_attributes(best.where("ok").join(category, "mpn").select("mpn", "category", "text"), responses)
    return delivery.assemble(rows, best, found, searched)


def run_batch(spark: SparkSession, path: str, out: str, fetched: DataFrame, responses: DataFrame, results: DataFrame | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Reads the catalog, writes the delivered rows and the review log below out, gives the counts by decision.

    A malformed line of the catalog costs its own row only, which is put up for review.
    """
    bad = corpus.malformed_rows(spark, path)
    rows = input_rows(spark, path, excluded)
    whole = rows.join(bad.select("Mfg_Part_Num", "Part_Desc").distinct(), ["Mfg_Part_Num", "Part_Desc"], "left_anti").select(rows.columns)
    done = run(whole, fetched, responses, results).unionByName(delivery.error_rows(bad, F.concat(F.lit("malformed line: "), F.left("_line", F.lit(80)))))
    sinks.write_delivery(done, f"{out}/delivery")
    sinks.write_review_log(done, f"{out}/review_log")
    log = spark.read.option("header", True).csv(f"{out}/review_log")
    return log.groupBy("decision").agg(F.count("*").alias("n"))
