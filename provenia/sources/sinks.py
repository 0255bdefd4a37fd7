"""Files that leave the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.sources.reference import delivery_header


def write_delivery(rows: DataFrame, path: str) -> None:
    """The delivered columns, all of them in their order, missing ones as empty text."""
    shown = rows.select(*[(F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in rows.columns else F.lit("")).alias(c) for c in delivery_header()])
    shown.write.mode("overwrite").option("header", True).option("quoteAll", False).option("emptyValue", "").option("escape", '"').csv(path)


def write_review_log(rows: DataFrame, path: str) -> None:
    """Part, decision, confidence and reasons of each row."""
    log = rows.select(F.col("Mfg_Part_Num").alias("mpn"), "decision", "confidence", F.array_join("reasons", " | ").alias("reasons"))
    log.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_lock(documents: DataFrame, path: str) -> None:
    """Digest, address and time of each document, as JSON lines."""
    documents.select("doc_id", "sha256", "url", "fetched_at").write.mode("overwrite").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)
