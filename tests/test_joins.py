"""Interval joins against nested loops."""

import random

import pytest
from pyspark.sql import functions as F

from provenia.operators import joins

SHAPE = "doc string, s long, e long, id int"


def plain(left, right, within):
    ok = (lambda a, b: b[1] <= a[1] and a[2] <= b[2]) if within else (lambda a, b: a[1] < b[2] and b[1] < a[2])
    real = lambda r: r[0] is not None and r[1] is not None and r[2] is not None and r[1] < r[2]
    return sorted((a[3], b[3]) for a in left for b in right if real(a) and real(b) and a[0] == b[0] and ok(a, b))


def spans(rng, n, long):
    rows = []
    for k in range(n):
        s = rng.randint(-500, 2000)
        rows.append((rng.choice(["x", "x", "x", "y"]), s, s + rng.choice([0, 1, 1, 5, 64, 65, rng.randint(1, long)]), k))
    return [*rows, (None, 1, 5, n), ("x", None, 5, n + 1), ("y", 3, None, n + 2), ("y", 9, 3, n + 3), ("x", -(10**9), 10**9, n + 4)]


@pytest.mark.parametrize("within", [False, True])
def test_pairs_meet_once(spark, within):
    rng = random.Random(17)
    left, right = spans(rng, 150, 300), spans(rng, 120, 3000)
    a, b = (spark.createDataFrame(rows, SHAPE).repartition(3) for rows in (left, right))
    want = plain(left, right, within)
    for width, hot in ((64, None), (7, 10)):  # in common bins, and in crowded ones
        got = joins.meeting(a, b, ["doc"], within=within, bin=width, hot=hot)
        assert sorted((r.left.id, r.right.id) for r in got.collect()) == want and len(want) > 100
    assert joins.meeting(a.limit(0), b, ["doc"]).count() == 0 and joins.meeting(a, b.limit(0), ["doc"]).count() == 0


def test_plan_has_no_nested_loop_and_rows_stay_bounded(spark):
    pages = spark.range(20_000).select(F.lit("d").alias("doc"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 10).alias("e"))
    points = spark.range(20_000).select(F.lit("d").alias("doc"), (F.col("id") * 9).alias("s"), (F.col("id") * 9 + 1).alias("e"))
    got = joins.meeting(points, pages, ["doc"], hot=500)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert got.where("left.s >= right.s AND left.s < right.e").count() == got.count() == 20_000
