import hashlib
import random
import re

from pyspark.sql import functions as F

from provenia.llm import exact_dedup as X


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    out, seen = [], set()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        n = normal(t)
        ids = [x for x in groups[n] if x is not None]
        keep = min(ids) if ids else None
        kept = i == keep and n not in seen
        if kept:
            seen.add(n)
        out.append((i, keep, len(groups[n]), kept, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(5, "a  b"), (2, "a\tb"), (9, "a b "), (1, None), (4, ""), (7, " "), (8, "\n\x0b"), (3, "a b"), (3, "a b"), (2, "a\tb"), (6, "é\x1cü"), (10, "é ü"), (None, "zz"), (None, "zz"), (11, "q" * 300)]


def got(spark, rows, n=3):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, sha int").repartition(n)
    return sorted(map(tuple, X.exact_duplicates(docs).collect()), key=str)


def test_edge_cases(spark):
    assert got(spark, ROWS) == expected(ROWS)


def test_chunks_combine(spark, monkeypatch):
    rng = random.Random(4)
    for _ in range(300):
        data = bytes(rng.choice(b"ab  \n\t") for _ in range(rng.randint(0, 30)))
        parts, at = (0, 0, False, False), 0
        while at < len(data):
            step = rng.randint(1, 6)
            parts = X.join(parts, X.chunk_hash(data[at : at + step]))
            at += step
        plain = re.sub(rb"[\x20\x09-\x0D]+", b" ", data)
        assert parts[:2] == X.chunk_hash(data)[:2] == (int.from_bytes(plain, "big") % X.PRIME, len(plain))
    monkeypatch.setattr(X, "CHUNK", 3)
    monkeypatch.setattr(X, "COMPARED", 2)
    assert got(spark, ROWS) == expected(ROWS)


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    real = X._hashes
    monkeypatch.setattr(X, "_hashes", lambda: lambda texts: [{"h": "0" * 33, "n": 1, "first": False, "last": False} for _ in texts])
    assert got(spark, ROWS) == expected(ROWS)
    monkeypatch.setattr(X, "_hashes", real)


def test_shuffle_join_of_duplicates(spark, monkeypatch):
    monkeypatch.setattr(X, "BROADCAST_ROWS", -1)
    assert got(spark, ROWS) == expected(ROWS)


def test_empty_and_hot(spark):
    assert X.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    hot = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    assert X.exact_duplicates(hot).where("kept").count() == 2000 - 667 + 1


def test_scratch_tables_are_few_files(spark, monkeypatch, tmp_path):
    """However many partitions a shuffle has, a narrow scratch table is a file a core at most."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    monkeypatch.setattr("provenia.llm.common.scratch_dir", lambda _: f"file://{tmp_path}/{len(list(tmp_path.iterdir()))}")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = [(i, f"text {i % 400}") for i in range(1000)] + [(7, "text 7")] * 3
        assert got(spark, rows) == expected(rows)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    files = [len(list(d.glob("*.parquet"))) for d in tmp_path.iterdir()]
    assert len(files) >= 4 and max(files) <= spark.sparkContext.defaultParallelism
