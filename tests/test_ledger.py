from datetime import datetime

from pyspark.sql import functions as F

from provenia.operators import ledger
from provenia.streaming import ledger as stream
from provenia.streaming import reviews

LOG = "id long, ts timestamp, sku string, attribute string, action string, actor string, detail string"


def log(spark, *rows):
    return spark.createDataFrame([(i, datetime(2024, 1, 1, 0, t), s, "a", act, "x", f'{{"corrected_value": "{v}"}}') for i, t, s, act, v in rows], LOG)


ROWS = [(1, 1, "S", "ACCEPT", ""), (2, 2, "S", "REJECT", ""), (3, 2, "S", "CORRECT", "7 V"), (4, 1, "T", "REJECT", ""), (5, 9, "T", "AUTO_PUBLISH", ""), (6, 3, "U", "ACCEPT", "")]


def test_latest_review_wins(spark):
    got = {r.sku: (r.decision, r.corrected) for r in ledger.latest_reviews(log(spark, *ROWS)).collect()}
    assert got == {"S": ("AUTO_PUBLISH", "7 V"), "T": ("REJECT", None), "U": ("AUTO_PUBLISH", None)}


def test_corrections_change_the_value(spark):
    decided = spark.createDataFrame([("S", "a", 5.0, None, "5 V", "REVIEW"), ("T", "a", None, "x", "x", "AUTO_PUBLISH"), ("V", "a", 1.0, None, "1", "REVIEW")], "sku string, attribute string, value_num double, value_str string, display string, decision string")
    got = {r.sku: r for r in ledger.apply_reviews(decided, log(spark, *ROWS)).collect()}
    assert (got["S"].value_num, got["S"].display, got["S"].decision) == (7.0, "7 V", "AUTO_PUBLISH")
    assert got["T"].decision == "REJECT" and got["V"].decision == "REVIEW"


def test_empty_corrections_are_refused(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 1), "S", "a", "CORRECT", "x", " ", ""), (datetime(2024, 1, 1), "S", "a", "CORRECT", "x", "5", "")], "ts timestamp, sku string, attribute string, action string, actor string, corrected_value string, note string")
    assert ledger.review_rows(rows).count() == 1


def test_stream_gives_the_fold(spark, tmp_path):
    events = str(tmp_path / "events")
    log(spark, *ROWS[:3]).write.parquet(events)
    source = lambda: stream.read_events(spark, events, files_per_batch=1, lateness="1 day")
    run = lambda: stream.fold_into(source(), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    run()
    log(spark, *ROWS[3:], ROWS[0]).write.mode("append").parquet(events)
    run()
    key = lambda df: sorted(map(str, df.select("sku", "attribute", "decision", "corrected").collect()))
    assert key(stream.current(spark, str(tmp_path / "state"))) == key(ledger.latest_reviews(log(spark, *ROWS)))


def test_batches_are_merged_now_and_then(spark, tmp_path):
    events, state = str(tmp_path / "events"), str(tmp_path / "state")
    assert stream.current(spark, state).count() == 0
    for row in [*ROWS, (7, 10, "T", "ACCEPT", "")]:
        log(spark, row).coalesce(1).write.mode("append").parquet(events)
        stream.fold_into(stream.read_events(spark, events, files_per_batch=1, lateness="1 day"), state, str(tmp_path / "cp"), every=3).awaitTermination()
    key = lambda df: sorted(map(str, df.select("sku", "attribute", "decision", "corrected").collect()))
    assert key(stream.current(spark, state)) == key(ledger.latest_reviews(log(spark, *ROWS, (7, 10, "T", "ACCEPT", ""))))
    assert len([p for p in (tmp_path / "state" / "merged").iterdir() if p.is_dir()]) == 1
    assert len([p for p in (tmp_path / "state" / "deltas").iterdir() if p.is_dir()]) < 3


def test_windows_close_behind_the_watermark(spark, tmp_path):
    events = str(tmp_path / "events")
    log(spark, *ROWS).withColumn("ts", F.col("ts") + F.expr("make_interval(0, 0, 0, CAST(id AS INT))")).write.parquet(events)
    counts = stream.action_counts(stream.read_events(spark, events, lateness="1 hour"))
    q = counts.writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").count() >= 1


def test_state_gives_the_fold_and_goes_on_after_a_restart(spark, tmp_path):
    events, checkpoint = str(tmp_path / "events"), str(tmp_path / "cp")
    source = lambda: stream.read_events(spark, events, files_per_batch=1, lateness="1 day")
    log(spark, *ROWS[:3]).coalesce(1).write.parquet(events)
    reviews.keep_latest(source(), checkpoint).awaitTermination()
    log(spark, *ROWS[3:], ROWS[0], (9, 0, "S", "REJECT", "")).coalesce(1).write.mode("append").parquet(events)
    reviews.keep_latest(source(), checkpoint).awaitTermination()
    key = lambda df: sorted(map(str, df.select("sku", "attribute", "decision", "corrected").collect()))
    assert key(reviews.kept(spark, checkpoint)) == key(ledger.latest_reviews(log(spark, *ROWS)))


def test_state_forgets_quiet_keys(spark, tmp_path):
    events, checkpoint = str(tmp_path / "events"), str(tmp_path / "cp")
    at = lambda df, days: df.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {days} DAYS"))
    for days, row in ((0, (1, 1, "S", "ACCEPT", "")), (5, (2, 1, "T", "REJECT", "")), (40, (3, 1, "U", "ACCEPT", "")), (41, (4, 1, "U", "REJECT", ""))):
        at(log(spark, row), days).coalesce(1).write.mode("append").parquet(events)
        reviews.keep_latest(stream.read_events(spark, events, lateness="1 hour"), checkpoint, quiet_days=20).awaitTermination()
    assert {r.sku: r.decision for r in reviews.kept(spark, checkpoint).collect()} == {"U": "REJECT"}
