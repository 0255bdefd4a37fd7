"""The ledger as a stream: review events in, the latest decision of each attribute out."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from provenia.operators.ledger import ACTIONS, latest_reviews
from provenia.sources.scratch import delete

EVENT = "id long, ts timestamp, sku string, attribute string, action string, actor string, detail string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 16, lateness: str = "1 hour") -> DataFrame:
    """Audit events from Parquet files as they arrive; an event id seen again within the lateness is dropped."""
    events = spark.readStream.schema(StructType.fromDDL(EVENT)).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return events.where(F.col("action").isin(*ACTIONS)).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["id"])


def action_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Events of each action in tumbling windows; a window is out once the watermark has passed it."""
    return events.groupBy(F.window("ts", width).alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "action", "n")


def fold_into(events: DataFrame, state: str, checkpoint: str, every: int = 64) -> StreamingQuery:
    """Keeps at `state` the latest review of each attribute.

    A batch writes the latest reviews of its own events, under its number, so a batch that
    is run again after a failure gives the same folder, and costs what its events cost.
    After every `every` batches these folders are merged into one.
    """

    def merge(batch: DataFrame, number: int) -> None:
        _latest(batch).write.mode("overwrite").parquet(f"{state}/deltas/batch={number}")
        if number % every == every - 1:
            compact(batch.sparkSession, state, number)

    return events.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start()


def _latest(events: DataFrame) -> DataFrame:
    columns = StructType.fromDDL(EVENT).names
    return events.groupBy("sku", "attribute").agg(F.max_by(F.struct(*columns), F.struct("ts", "id")).alias("x")).select("x.*")


def _parts(spark: SparkSession, path: str, number: str) -> DataFrame | None:
    """The event rows below path with the number of their folder; None if there are none."""
    try:
        return spark.read.schema(StructType.fromDDL(EVENT).add(number, "long")).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return None


def _rows(spark: SparkSession, state: str) -> tuple[DataFrame | None, int]:
    """Rows of the newest merged folder and of the batches after it, and the number that the former goes up to."""
    merged, deltas = _parts(spark, f"{state}/merged", "upto"), _parts(spark, f"{state}/deltas", "batch")
    upto = -1 if merged is None else merged.agg(F.max("upto")).first()[0]
    upto = -1 if upto is None else upto
    parts = [] if merged is None else [merged.where(F.col("upto") == upto).drop("upto")]
    parts += [] if deltas is None else [deltas.where(F.col("batch") > upto).drop("batch")]
    return (reduce(DataFrame.unionByName, parts) if parts else None), upto


def compact(spark: SparkSession, state: str, number: int) -> None:
    """Merge what there is up to a batch into one folder, then remove what that replaces."""
    rows, before = _rows(spark, state)
    if rows is None or before >= number:
        return
    _latest(rows).write.mode("overwrite").parquet(f"{state}/merged/upto={number}")
    if before >= 0:
        delete(spark, f"{state}/merged/upto={before}")
    for k in range(before + 1, number + 1):
        delete(spark, f"{state}/deltas/batch={k}")


def current(spark: SparkSession, state: str) -> DataFrame:
    """(sku, attribute, decision, corrected) as of the newest batch."""
    rows, _ = _rows(spark, state)
    return latest_reviews(spark.createDataFrame([], EVENT) if rows is None else rows)
