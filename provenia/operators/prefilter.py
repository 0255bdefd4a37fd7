"""Rows whose key is among known ones, most of the others left out before anything is shuffled.

The known keys are hashed to bits, and the bits gathered by bitmap aggregates, which
executors build in parts and merge by OR. A row whose bit is not set has no known key and
goes where it stands; the few that are left meet the keys in an exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each known key: of rows without one, one in so many is left. Bits of a bitmap, and bitmaps that may be broadcast.
BITS, WIDTH, MOST = 16, 32_768, 1024


def _bit(key: Column, bits: int) -> Column:
    """Where a key's bit is, from 1 to a number of bits, as bitmap functions count."""
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def bitmaps(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(bucket, bitmap) of the bits of all keys; a bitmap has 4 KB."""
    placed = keys.where(F.col(key).isNotNull()).select(_bit(F.col(key), bits).alias("bit"))
    return placed.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))


def merged(*parts: DataFrame) -> DataFrame:
    """Bitmaps of several sets of keys as those of all, without the keys."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def maybe_known(rows: DataFrame, key: str, maps: DataFrame, bits: int) -> DataFrame:
    """The rows whose key's bit is set: all that have a known key, and few others. maps are at most MOST, so they are broadcast."""
    place = F.bitmap_bit_position(_bit(F.col(key), bits))
    octet = F.conv(F.hex(F.substring("bitmap", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.call_function("getbit", octet, (place % 8).cast("int")) == 1
    marked = rows.withColumn("_bucket", F.bitmap_bucket_number(_bit(F.col(key), bits)))
    return marked.join(F.broadcast(maps.withColumnRenamed("bucket", "_bucket")), "_bucket").where(held).drop("_bucket", "bitmap")


def bits_for(n: int) -> int | None:
    """Bits for n keys, whole bitmaps of them; None if these were more than MOST."""
    maps = max(1, -(-n * BITS // WIDTH))
    return maps * WIDTH if maps <= MOST else None


def known_only(rows: DataFrame, keys: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """The rows whose key is among keys (distinct or not), exactly, as a semi-join gives them.

    n: about how many keys there are, counted if it is not given. Up to some two million
    keys (MOST bitmaps, 4 MB) rows are sifted by bitmaps first; beyond that the join is all.
    """
    bits = bits_for(keys.count() if n is None else n)
    sifted = rows if bits is None else maybe_known(rows, key, bitmaps(keys, key, bits), bits)
    return sifted.join(keys.select(key), key, "left_semi").select(rows.columns)
