"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import cut, join_splittable, remove


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (u, v); root is the component's smallest node.

    Each round joins every edge with its end's smallest neighbour, which is aggregated
    before it is shuffled; no group of neighbours is gathered anywhere. Rounds grow with
    the logarithm of a component's diameter. A node with many
    neighbours is dealt out over tasks by adaptive joins. Every round is a table in the
    shared folder, which goes when the next one is there.
    Rows with a null end are ignored; no edges give no rows.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), few=True)
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = join_splittable(both.where("v > u"), low, "u", "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_splittable(large, low, "u", "inner").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        old, now, before = now, cut(small, few=True), state
        state = _state(now)
        remove(old)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
