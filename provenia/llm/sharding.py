"""Shards of near equal bytes: a minimax contiguous partition of ordered groups.

Rows with equal texts form a group, which is never cut. Groups are ordered by a 64-bit
hash of their text; groups larger than an even share come first, each a shard of its own.
For the rest the smallest shard capacity that suffices is found by binary search, each
capacity checked greedily. The sizes the check needs are sums over ranges of the hash:
4096 at first; a range in which a cut may fall is divided by 256 until the cut falls
between groups. So the driver sees a bounded number of sums at any input size, and the
result is the same as with all groups in one list. Only DataFrame functions touch rows.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenia.llm.common import cut

SHARDS = 16
#: Bits of the hash by which ranges are cut at first and later.
FIRST_BITS, MORE_BITS = 12, 8
#: Cells in which slots are numbered: at most this many, of at least so many rows on average.
CELLS, CELL_ROWS = 61_440, 256


class _Ranges:
    """Consecutive ranges of groups: (bits, value) of the hash, bytes, number of groups."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        self.rows = sorted(((bits, value % (1 << 64), *more) for bits, value, *more in rows), key=lambda r: r[1] << (64 - r[0]))
        self.ends = [0]
        for r in self.rows:
            self.ends.append(self.ends[-1] + r[2])
        self.total = self.ends[-1]

    def cuts(self, capacity: int, shards: int, inside: bool) -> tuple[list[int], set[int]] | None:
        """Where greedy shards begin, as bytes, and the ranges in which they end; None if they are too many.

        inside: ranges of several groups may be cut at any byte.
        """
        at, starts, hit = 0, [], set()
        while self.total - at > capacity:
            i = bisect_right(self.ends, at + capacity) - 1
            several = self.rows[i][3] > 1
            if several:
                hit.add(i)
            to = at + capacity if inside and several else self.ends[i]
            starts.append(to)
            if to <= at or len(starts) >= shards:
                return None
            at = to
        return starts, hit

    def smallest(self, shards: int, inside: bool) -> int:
        low, high = -(-self.total // shards), self.total
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, inside):
                high = mid
            else:
                low = mid + 1
        return low

    def open(self, shards: int) -> tuple[int, set[int]]:
        """The capacity known to suffice, and the ranges to divide before it is known to be the smallest."""
        least, enough = self.smallest(shards, True), self.smallest(shards, False)
        if least == enough:
            return enough, set()
        near = {j for capacity, inside in ((least, True), (enough, False)) for i in self.cuts(capacity, shards, inside)[1] for j in (i - 1, i, i + 1) if 0 <= j < len(self.rows)}
        return enough, {j for j in near if self.rows[j][3] > 1}


def _prefix(bits: int) -> Column:
    """The first bits of the hash g, whose signed order is kept."""
    return F.shiftrightunsigned(F.col("g").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits)


def _sums(groups: DataFrame, bits: int) -> DataFrame:
    return groups.groupBy(_prefix(bits).alias("value")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).select(F.lit(bits).alias("bits"), "value", "bytes", "n")


def plan(groups: DataFrame, shards: int) -> tuple[list[int], list[int], int]:
    """(hashes of groups that are shards of their own, first hashes of the other shards but one, capacity) of groups (g, bytes)."""
    total = groups.agg(F.sum("bytes")).first()[0]
    if total is None:
        return [], [], 0
    giants, rest, left = [], total, shards
    for g, size in groups.select("g", "bytes").orderBy(F.desc("bytes"), "g").limit(shards).collect():
        if left < 2 or size * left <= rest:
            break
        giants.append((g, size))
        rest, left = rest - size, left - 1
    if giants:
        groups = groups.where(~F.col("g").isin([g for g, _ in giants]))
    ranges = _Ranges([tuple(r) for r in _sums(groups, FIRST_BITS).collect()])
    capacity, todo = ranges.open(left)
    while todo:
        divided = None
        for bits in {ranges.rows[i][0] for i in todo}:
            values = [ranges.rows[i][1] for i in todo if ranges.rows[i][0] == bits]
            part = _sums(groups.where(_prefix(bits).isin(values)), min(64, bits + MORE_BITS))
            divided = part if divided is None else divided.unionByName(part)
        ranges = _Ranges([r for i, r in enumerate(ranges.rows) if i not in todo] + [tuple(r) for r in divided.collect()])
        capacity, todo = ranges.open(left)
    starts, _ = ranges.cuts(capacity, left, False) or ([], None)
    first = [ranges.rows[ranges.ends.index(s)] for s in starts]
    return [g for g, _ in giants], [(r[1] << (64 - r[0])) - (1 << 63) for r in first], max([capacity, *(s for _, s in giants)])


def balanced_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row of docs.

    size is the UTF-8 length of the text plus 1; null counts as empty. slot runs from 0
    without gaps in each shard. Repeated rows and null ids each get a slot; an empty
    table gives no rows, and a shard may stay empty where groups are fewer than shards.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(F.col(id_col).alias("id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("crc"), F.xxhash64(body).alias("g"), F.monotonically_increasing_id().alias("row")), narrow=True)
    groups = cut(rows.groupBy("g").agg(F.sum("size").alias("bytes")))
    giants, starts, _ = plan(groups, shards)
    shard = F.lit(len(giants))
    for start in starts:
        shard = shard + (F.col("g") >= start).cast("int")
    for k, g in enumerate(giants):
        shard = F.when(F.col("g") == g, k).otherwise(shard)
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("bucket", _prefix(FIRST_BITS))
    # Slots: rows are numbered within cells, of which a large bucket has several, and each cell after those before it.
    buckets = cut(placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")))
    share = max(CELL_ROWS, -(-(buckets.agg(F.sum("n")).first()[0] or 0) // CELLS))
    salted = placed.join(F.broadcast(buckets.select("shard", "bucket", F.ceil(F.col("n") / share).alias("salts"))), ["shard", "bucket"])
    celled = salted.withColumn("cell", F.pmod(F.xxhash64("row"), F.col("salts"))).drop("salts")
    sizes = celled.groupBy("shard", "bucket", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket", "cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cut(sizes.select("shard", "bucket", "cell", F.coalesce(before, F.lit(0)).alias("offset")))
    at = F.row_number().over(Window.partitionBy("shard", "bucket", "cell").orderBy("row"))
    numbered = celled.withColumn("at", at).join(F.broadcast(offsets), ["shard", "bucket", "cell"])
    return numbered.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("offset") + F.col("at") - 1).alias("slot"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of documents."""
    placed = balanced_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
