"""Joins by order: the last row at or before another, and rows whose intervals meet."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """left with `value` of the last row of right at or before it in `on`, for the same `by`; null if none.

    Both sides are put in one order and the value carried forward: linear in the rows, with
    no pairs. Of right rows with equal `on` the greatest value stands; null values and a
    null `on` count for nothing. bucket, a function of `on` that never falls as `on` rises
    (such as F.to_date), parts a hot key's rows: what was last before each bucket is found
    among one row for each, and no window is longer than a bucket.
    """
    part = F.lit(0) if bucket is None else bucket(F.col(on))
    marks = right.where(F.col(on).isNotNull() & F.col(value).isNotNull()).groupBy(*by, on).agg(F.max(value).alias("_v")).select(*by, part.alias("_part"), F.col(on).alias("_on"), F.lit(0).alias("_left"), "_v")
    rows = left.withColumn("_row", F.struct(*left.columns)).select(*by, part.alias("_part"), F.col(on).alias("_on"), F.lit(1).alias("_left"), "_row")
    both = rows.unionByName(marks, allowMissingColumns=True)
    if bucket is not None:
        ends = both.groupBy(*by, "_part").agg(F.max_by("_v", F.when(F.col("_left") == 0, F.col("_on"))).alias("_end"))
        before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        carried = ends.select(*by, "_part", before.alias("_v"), F.lit(-1).alias("_left"))
        both = both.unionByName(carried, allowMissingColumns=True)
    last = F.last("_v", ignorenulls=True).over(Window.partitionBy(*by, "_part").orderBy(F.when(F.col("_left") < 0, 0).otherwise(1), "_on", "_left").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_last", last).where("_left = 1")
    return found.select("_row.*", F.when(F.col("_on").isNotNull(), F.col("_last")).alias(value))


#: Rows of one side in a bin from which it is dealt to several tasks.
HOT = 50_000


def meeting(left: DataFrame, right: DataFrame, by: list[str], spans: tuple[str, str] = ("s", "e"), within: bool = False, bin: int = 64, hot: int | None = None) -> DataFrame:
    """(by, left, right) for each pair of rows of equal `by` whose intervals meet: both rows as structs.

    spans names the columns (start, end) of whole numbers on either side, ends exclusive; a
    point is an interval of length 1. within: only pairs whose left interval lies within the
    right one. Rows with a null in `by` or a span, or an empty span, meet nothing.

    Intervals are put in equal bins, those longer than `bin` in bins of twice, four times ...
    its width, so that each is in two at most. A pair meets on the level of the longer one
    and is kept in the first bin that both have: each pair once, by an equality join. A row
    is dealt once to each level that the other side has above its own: at most two rows for
    each doubling of the longest interval. Bins in which the left side has more than `hot`
    rows are parted by a hash of them, the right side's rows of these go to each part.
    """
    hot = HOT if hot is None else hot
    s, e = (F.col(c).cast("long") for c in spans)
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col("_e") - F.col("_s")) / F.lit(bin)))).cast("int")

    def placed(rows: DataFrame, side: str) -> DataFrame:
        known = rows.where(s < e).select(*by, F.struct(*rows.columns).alias(side), s.alias("_s"), e.alias("_e"))
        return known.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by], F.lit(True))).withColumn("_own", level)

    sides = [placed(left, "left"), placed(right, "right")]
    levels = [sorted(r["_own"] for r in side.select("_own").distinct().collect()) for side in sides]  # one for each doubling

    def binned(side: DataFrame, others: list[int], name: str) -> DataFrame:
        above = F.filter(F.array(*map(F.lit, others)) if others else F.array().cast("array<int>"), lambda k: k > F.col("_own"))
        each = side.withColumn("_level", F.explode(F.array_union(F.array("_own"), above)))
        wide = F.lit(bin) * F.pow(F.lit(2.0), F.col("_level"))
        spots = F.sequence(F.floor(F.col("_s") / wide), F.floor((F.col("_e") - 1) / wide))
        return each.withColumn("_bin", F.explode(spots)).withColumnsRenamed({"_s": f"_{name}s", "_e": f"_{name}e", "_own": f"_{name}own"}).withColumn("_wide", wide)

    a, b = binned(sides[0], levels[1], "l"), binned(sides[1], levels[0], "r").drop("_wide")
    key = [*by, "_level", "_bin"]
    crowded = a.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(*key, F.ceil(F.col("_n") / hot).cast("int").alias("_parts"))
    if not crowded.isEmpty():
        part = F.pmod(F.xxhash64("left"), F.coalesce("_parts", F.lit(1)))
        a = a.join(crowded, key, "left").withColumn("_part", part.cast("int")).drop("_parts")
        b = b.join(crowded, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        key = [*key, "_part"]
    meet = (F.col("_ls") < F.col("_re")) & (F.col("_rs") < F.col("_le"))
    if within:
        meet = (F.col("_rs") <= F.col("_ls")) & (F.col("_le") <= F.col("_re"))
    once = (F.col("_level") == F.greatest("_lown", "_rown")) & (F.col("_bin") == F.floor(F.greatest("_ls", "_rs") / F.col("_wide")))
    return a.join(b, key).where(meet & once).select(*by, "left", "right")


def nth_of(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, cells): the values of a group in order, as aligned arrays are read by position."""
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("cells"))
