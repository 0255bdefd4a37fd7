"""Dropping rows of a table by what an operator found out about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import cut

#: Keys (16 bytes) up to which they are broadcast rather than joined by a shuffle of the table.
BROADCAST_ROWS = 200_000


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))


def keep_one_of_each(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs, all columns, with one row for each class of rows (id, h64, class).

    A row is known by its id and the hash of its text. The row that stays is that of the
    smallest id (null last), then hash; of repeated rows with that id and text, one.
    """
    names = docs.columns
    first = rows.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h64")).alias("first"), F.count("*").alias("n")).where("n > 1").select("class", "first")
    key = F.struct(F.col("id").isNull().alias("none"), "id", "h64")
    twin = F.pmod(F.hash("class"), F.lit(2))
    many = rows.withColumn("twin", twin).join(first.withColumn("twin", twin), ["class", "twin"]).select("id", "h64", (key == F.col("first")).alias("stays"))
    found = cut(many.groupBy("id", "h64").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), few=True)
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    row, known = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_col}`").alias("row_id"), text_hash(text_col).alias("row_hash")), found
    marked = row.join(known, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("h64")), "left")
    alone = marked.where("stays is null").select("row")
    # Repeats of a row that stays: few keys, one row each.
    again = marked.where("stays").groupBy("row_id", "row_hash").agg(F.first("row").alias("row")).select("row")
    return alone.unionByName(again).select(*[F.col(f"row.`{c}`") for c in names])
