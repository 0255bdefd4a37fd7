"""Exact duplicates by polynomial fingerprints that combine from chunk to chunk.

A text, with each run of ASCII white space taken as one space, is a number in base 256;
its fingerprint is that number modulo a prime, kept with its length. Chunks of a huge
text are hashed in parallel tasks and combined by shifting by the length of what follows:
H(ab) = H(a) * 256^|b| + H(b). Where a run of white space spans two chunks, the second
loses its leading space, which is subtracted the same way. Texts with equal fingerprints
are then compared chunk by chunk: within each (fingerprint, chunk) the smallest and the
largest chunk must be equal. That needs no pairs and combines before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import SPACE, cut, join_splittable, text_pass
from provenia.llm.rows import keep_one_of_each

#: The smallest prime above 2**128.
PRIME = 2**128 + 51
#: Bytes hashed at a time, bytes of a text dealt to one task, bytes compared at a time.
PIECE, CHUNK, COMPARED = 1 << 12, 1 << 22, 1 << 16
#: Repeats of a row that are put back at a time.
PUT_BACK = 100_000
#: Rows of duplicates up to which their keys (some 60 bytes each) are broadcast.
BROADCAST_ROWS = 100_000
_WHITE = b" \t\n\r\x0b\x0c"


def join(a: tuple, b: tuple) -> tuple:
    """The (hash, length, begins with space, ends with space) of two normalised neighbours."""
    if not a[1] or not b[1]:
        return a if a[1] else b
    h, n = b[0], b[1]
    if a[3] and b[2]:
        n -= 1
        h = (h - 32 * pow(256, n, PRIME)) % PRIME
    return (a[0] * pow(256, n, PRIME) + h) % PRIME, a[1] + n, a[2], b[3] if n else a[3]


def chunk_hash(data: bytes) -> tuple:
    """(hash, length, begins with space, ends with space) of the normalised chunk."""
    if not data:
        return 0, 0, False, False
    first, last = data[:1] in _WHITE, data[-1:] in _WHITE
    words = data.split()
    plain = b" ".join([b"", *words, b""][not first : len(words) + 1 + last]) if words else b" "
    h = 0
    for at in range(0, len(plain), PIECE):
        part = plain[at : at + PIECE]
        h = (h * pow(256, len(part), PRIME) + int.from_bytes(part, "big")) % PRIME
    return h, len(plain), first, last


def _normal(text_col: str):
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{SPACE}+", " ")


def _hashes() -> callable:
    def one(data: bytes) -> dict:
        h, n, first, last = chunk_hash(data)
        return {"h": f"{h:033x}", "n": n, "first": first, "last": last}

    return lambda texts: [one(t) for t in texts]


_HASH = "h string, n long, first boolean, last boolean"


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h64, fp, sha): h64 names the row's text, fp is the fingerprint with the length."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    base = base.select("id", "body", F.xxhash64("body").alias("h64"), F.length("body").alias("size"))
    sha = F.sha2(F.regexp_replace(F.col("body").cast("string"), f"{SPACE}+", " "), 256)
    short = text_pass(base.where(F.col("size") <= CHUNK).withColumn("sha", sha), _hashes, _HASH, "body", ["id", "h64", "sha"])
    short = short.select("id", "h64", "sha", F.concat("h", F.lit(":"), "n").alias("fp"))
    long = base.where(F.col("size") > CHUNK).withColumn("row", F.monotonically_increasing_id()).withColumn("sha", sha)
    at = F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / CHUNK).cast("int"))).alias("at")
    parts = long.select("row", "id", "h64", "sha", "body", at).select("row", "id", "h64", "sha", "at", F.expr(f"substring(body, at * {CHUNK} + 1, {CHUNK})").alias("body"))
    parts = text_pass(parts.repartition("row", "at"), _hashes, _HASH, "body", ["row", "id", "h64", "sha", "at"])
    grouped = parts.groupBy("row", "id", "h64", "sha").agg(F.array_sort(F.collect_list(F.struct("at", "h", "n", "first", "last"))).alias("parts"))

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = []
            for parts in batch.column("parts").to_pylist():
                all_of = (0, 0, False, False)
                for p in parts:
                    all_of = join(all_of, (int(p["h"], 16), p["n"], p["first"], p["last"]))
                fps.append(f"{all_of[0]:033x}:{all_of[1]}")
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h64"), batch.column("sha"), pa.array(fps, pa.string())], names=["id", "h64", "sha", "fp"])

    kind = dict(base.dtypes)["id"]
    long = grouped.select("id", "h64", "sha", "parts").mapInArrow(fold, f"id {kind}, h64 long, sha string, fp string")
    return short.unionByName(long)


def _unequal(docs: DataFrame, marked: DataFrame, twins: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The fingerprints (fp) of which some chunk differs between texts."""
    keys = marked.join(twins.select("fp"), "fp", "left_semi").select("id", "h64", "fp").distinct()
    keys = cut(keys, few=True)
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    body = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id2"), F.xxhash64(body.cast("binary")).alias("h64"), F.col(text_col).alias("body"))
    texts = texts.join(keys, (F.col("id2").eqNullSafe(F.col("id"))) & (texts.h64 == keys.h64)).select("fp", _normal("body").cast("binary").alias("body"))
    at = F.explode(F.sequence(F.lit(0), F.floor(F.length("body") / COMPARED).cast("int"))).alias("at")
    chunks = texts.select("fp", "body", at).select("fp", "at", F.expr(f"substring(body, at * {COMPARED} + 1, {COMPARED})").alias("chunk"))
    return chunks.groupBy("fp", "at").agg((F.min("chunk") != F.max("chunk")).alias("differ")).where("differ").select("fp").distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, h64, sha, fp) for each row, fp telling unequal texts apart, and (fp, group_size, keep_id) where it has several rows."""
    marked = cut(fingerprints(docs, id_col, text_col), few=True)
    sizes = marked.groupBy("fp").agg(F.count("*").alias("group_size"), F.min("id").alias("keep_id"))
    twins = cut(sizes.where("group_size > 1"), few=True)
    bad = cut(_unequal(docs, marked, twins, id_col, text_col), few=True)
    if bad.count():  # different texts of one fingerprint: told apart by their SHA-256
        key = F.when(F.col("bad"), F.concat("fp", F.lit(":"), "sha")).otherwise(F.col("fp"))
        marked = cut(marked.join(bad.withColumn("bad", F.lit(True)), "fp", "left").withColumn("bad", F.coalesce("bad", F.lit(False))).select("id", "h64", "sha", key.alias("fp")), few=True)
        twins = cut(marked.groupBy("fp").agg(F.count("*").alias("group_size"), F.min("id").alias("keep_id")).where("group_size > 1"), few=True)
        if _unequal(docs, marked, twins, id_col, text_col).count():
            raise ValueError("texts with equal fingerprints and digests differ")
    return marked, twins


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each group of equal texts: that of the smallest id."""
    marked, _ = _classes(docs.select(id_col, text_col), id_col, text_col)
    return keep_one_of_each(docs, marked.select("id", "h64", F.col("fp").alias("class")), id_col, text_col)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row of docs.

    Texts are equal when they are after replacing each run of ASCII white space by one
    space; null counts as empty. The row with the smallest id stays (null ids come last);
    of repeated rows with that id, one. Text columns may be of any length, the table
    empty; other columns play no part.
    """
    docs = docs.select(id_col, text_col)
    marked, twins = _classes(docs, id_col, text_col)
    named = join_splittable(marked, twins, "fp").select("id", "sha", "fp", F.coalesce("group_size", F.lit(1)).alias("group_size"), F.coalesce("keep_id", "id").alias("keep_id"))
    # Rows of one id and text are the same row: they are counted, and put back by their count; one of them may stay.
    same = named.groupBy("id", "sha", "fp", "group_size", "keep_id").agg(F.count("*").alias("n"))
    block = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PUT_BACK))).alias("block")
    each = F.explode(F.sequence(F.lit(1), F.least(F.col("n") - F.col("block") * PUT_BACK, F.lit(PUT_BACK)))).alias("k")
    first = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("block") == 0) & (F.col("k") == 1)
    out = same.select("*", block).select("*", each).withColumn("kept", first)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of documents."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
