import random
import zlib

from pyspark.sql import functions as F

from provenia.llm import sharding


def slow_capacity(sizes, shards):
    def enough(c):
        n, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                n, room = n + 1, c
            room -= s
        return n <= shards

    return next(c for c in range(max(sizes), sum(sizes) + 1) if enough(c))


def test_capacity_is_the_smallest(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 3)
    monkeypatch.setattr(sharding, "MORE_BITS", 2)
    rng = random.Random(5)
    for shards, n, top in ((4, 60, 50), (16, 200, 9), (3, 5, 100), (16, 7, 30)):
        groups = [(rng.getrandbits(64) - (1 << 63), rng.randint(1, top)) for _ in range(n)]
        giants, starts, capacity = sharding.plan(spark.createDataFrame(groups, "g long, bytes long"), shards)
        rest = [b for g, b in sorted(groups) if g not in giants]
        want = slow_capacity(rest, shards - len(giants)) if rest else 0
        assert capacity == max([want, *(b for g, b in groups if g in giants)])
        loads = {}
        for g, b in groups:
            k = g if g in giants else sum(g >= s for s in starts)
            loads[k] = loads.get(k, 0) + b
        assert max(loads.values()) <= capacity and len(loads) <= shards


def check(spark, docs, shards=16):
    rows = sharding.balanced_shards(docs, shards).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert set(by) <= set(range(shards))
    return rows, by


def test_rows_groups_and_slots(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["é" * rng.randint(0, 50), "copy", None, "", "x" * rng.randint(1, 400)]), 7) for i in range(700)]
    rows += rows[:5] + [(None, "copy", 1)]
    got, by = check(spark, spark.createDataFrame(rows, "doc_id long, text string, g int").repartition(3))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    home = {}
    text = {i: t for i, t, _ in rows}
    for r in got:
        home.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in home.values())
    loads = [sum(r.size for r in own) for own in by.values()]
    assert max(loads) <= sum(loads) / 16 + 3 * 401


def test_hot_group_gets_its_own_shard(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 20)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    _, by = check(spark, docs)
    loads = sorted(sum(r.size for r in own) for own in by.values())
    assert len(by) == 16 and loads[-1] == 9000 and loads[0] > 0.9 * loads[-2]


def test_empty_table(spark):
    assert check(spark, spark.createDataFrame([], "doc_id long, text string"))[0] == []


def test_long_texts_and_equal_sizes(spark):
    rows = [(i, f"{i:04d}" + "x" * 96) for i in range(400)] + [(900, "é" * 60_000), (901, "z" * 50_000)]
    got, by = check(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    loads = {k: sum(r.size for r in own) for k, own in by.items()}
    home = {r.doc_id: r.shard for r in got}
    assert loads[home[900]] == 120_001 and loads[home[901]] == 50_001 and home[900] != home[901]
    rest = [n for k, n in loads.items() if k not in (home[900], home[901])]
    assert sum(rest) == 400 * 101 and max(rest) == 29 * 101  # 400 rows in 14 shards
    again, _ = check(spark, spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7))
    assert {r.doc_id: r.shard for r in again} == home
