"""Bitmaps of known keys: nothing known is lost, little else is left."""

from pyspark.sql import functions as F

from provenia.operators import prefilter


def test_known_rows_stay_and_few_others(spark, monkeypatch):
    rows = spark.range(40_000).select(F.concat(F.lit("P"), F.col("id")).alias("part"), F.lit(1).alias("_x")).unionByName(spark.createDataFrame([(None, 1)], "part string, _x int"))
    keys = spark.range(0, 80_000, 16).select(F.concat(F.lit("P"), F.col("id")).alias("part")).unionByName(spark.createDataFrame([(None,), ("P0",)], "part string"))
    want = sorted(r.part for r in rows.join(keys, "part", "left_semi").collect())
    bits = prefilter.bits_for(5002)
    left = prefilter.maybe_known(rows, "part", prefilter.bitmaps(keys, "part", bits), bits)
    assert set(want) <= {r.part for r in left.collect()} and left.count() < len(want) + 40_000 * 2 / prefilter.BITS
    halves = [prefilter.bitmaps(keys.where(F.length("part") % 2 == k), "part", bits) for k in (0, 1)]
    assert prefilter.maybe_known(rows, "part", prefilter.merged(*halves), bits).count() == left.count()
    for most in (prefilter.MOST, 0):  # by bitmaps, and by the join alone
        monkeypatch.setattr(prefilter, "MOST", most)
        got = prefilter.known_only(rows, keys, "part")
        assert sorted(r.part for r in got.collect()) == want and got.columns == rows.columns
    assert prefilter.known_only(rows.limit(0), keys, "part").count() == prefilter.known_only(rows, keys.limit(0), "part").count() == 0


def test_fewer_rows_are_shuffled(spark):
    rows = spark.range(30_000).select(F.concat(F.lit("P"), F.col("id")).alias("part"))
    keys = spark.range(0, 30_000, 100).select(F.concat(F.lit("P"), F.col("id")).alias("part"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bits = prefilter.bits_for(300)
        left = prefilter.maybe_known(rows, "part", prefilter.bitmaps(keys, "part", bits), bits).count()
        assert prefilter.known_only(rows, keys, "part", 300).count() == 300 and left < 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
