"""The latest review of each attribute as the state of a stream, which forgets what has been quiet for long.

``transformWithState`` keeps one value for each (sku, attribute) in RocksDB, changes it as
events come and drops it by a timer on event time, so state is bounded by the keys that are
alive. What is kept can be read while the stream runs or after it, from its checkpoint.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from provenia.operators.ledger import latest_reviews

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times are microseconds, which Python workers take as they are.
LAST = "us long, id long, action string, detail string"


class LatestReview(StatefulProcessor):
    """State: the last event of a key by (us, id). Gives the events that became a key's last, and its end when that is forgotten."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LAST)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.last.get()
        best = before and tuple(before)
        for r in rows:
            one = (r.us, r.id, r.action, r.detail)
            best = one if best is None or one[:2] >= best[:2] else best
        if best is None or before is not None and best == tuple(before):
            return
        self.last.update(best)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(best[0] // 1000 + self.quiet_ms)
        yield Row(sku=key[0], attribute=key[1], us=best[0], id=best[1], action=best[2], detail=best[3], forgotten=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        us, number, action, detail = self.last.get()
        self.last.clear()
        yield Row(sku=key[0], attribute=key[1], us=us, id=number, action=action, detail=detail, forgotten=True)

    def close(self) -> None:
        pass


# The processor also runs beside the driver, where files that were added to the context are not on the path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@contextmanager
def _rocksdb(spark: SparkSession):
    """State stores of what starts or is read inside are RocksDB's."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def latest(events: DataFrame, quiet_days: int = 365) -> DataFrame:
    """Changes of the latest review of each attribute: (sku, attribute, us, id, action, detail, forgotten).

    events have a watermark on ts; those later than it are left out, an event seen again
    changes nothing. A key is forgotten once the watermark is quiet_days past its last event.
    """
    kept = events.select("sku", "attribute", "ts", F.unix_micros("ts").alias("us"), "id", "action", "detail")
    return kept.groupBy("sku", "attribute").transformWithState(LatestReview(quiet_days * 86_400_000), f"sku string, attribute string, {LAST}, forgotten boolean", "Update", "EventTime")


def keep_latest(events: DataFrame, checkpoint: str, quiet_days: int = 365) -> StreamingQuery:
    """Runs latest() over what there is of events and keeps its state below checkpoint; run again, it goes on from there."""
    with _rocksdb(events.sparkSession):
        return latest(events, quiet_days).writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(sku, attribute, decision, corrected) of the state as of the last batch of keep_latest()."""
    with _rocksdb(spark):
        state = spark.read.format("statestore").option("stateVarName", "last").load(checkpoint)
    return latest_reviews(state.select("key.sku", "key.attribute", F.timestamp_micros("value.us").alias("ts"), F.col("value.id").alias("id"), F.col("value.action").alias("action"), F.col("value.detail").alias("detail")))
