import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from provenia.llm import hard_negatives as hn

SHAPE = "vec_id long, embedding array<float>, label int"


def plain(rows, anchors, percent=(80, 100), most=(5, 5)):
    """By definition, over (id, label, vector) rows."""
    good = [(i, k, [math.floor(256 * float(np.float32(c))) for c in v]) for i, k, v in rows if k is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out, seen = [], set()
    for i, k, q in good:
        if i is None or not anchors(i) or (i, k, tuple(q)) in seen:
            continue
        seen.add((i, k, tuple(q)))
        scored = [(sum(a * b for a, b in zip(q, r, strict=True)), j, m) for j, m, r in good if len(r) == len(q)]
        key = lambda t: (-t[0], math.inf if t[1] is None else t[1])
        for ps, pid, _ in sorted((t for t in scored if t[2] == k and t[1] != i), key=key)[: most[0]]:
            fit = sorted((t for t in scored if t[2] != k and percent[0] * ps <= 100 * t[0] <= percent[1] * ps), key=key)[: most[1]]
            out += [(i, pid, r + 1, t[1], ps, t[0]) for r, t in enumerate(fit)]
    return sorted(out, key=str)


def relabelled(rows):
    return [(i, (k + 1) % 10 if i is not None and k is not None and i % 7 == 0 else k, v) for i, k, v in rows]


def vectors(seed, n, dim, labels=10, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(dim)] for _ in range(6)]
    return [(i, rng.randrange(labels), [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for i in range(n)]


def run(spark, tmp_path, rows):
    spark.createDataFrame([(i, v, k) for i, k, v in rows], SHAPE).repartition(3).write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
    return [tuple(r) for r in hn.op11_hard_negatives(spark, str(tmp_path)).collect()]


def test_query_against_plain_version(spark, tmp_path):
    rows = vectors(1, 520, 8)
    rows += [(600, 3, None), (700, None, [0.1] * 8), (800, 2, [0.1] * 7 + [None]), (900, 2, [0.1] * 7 + [math.nan]), (1000, 1, [math.inf] + [0.1] * 7), (1100, 1, [])]
    rows += [(None, 4, [0.3] * 8), (None, 5, [0.3] * 8), (1200, 5, [0.5] * 8), (1201, 5, [0.5] * 8), (1202, 4, [0.5] * 8), (1203, 4, [0.5] * 8), (1300, 1, [0.2] * 5), (1301, 1, [0.2] * 5), (1302, 2, [0.2] * 5)]
    rows += [rows[200], rows[200], rows[201], rows[202], (1400, 6, [-0.4] * 8), (1500, 6, [0.0] * 8)]
    assert sorted(run(spark, tmp_path, rows), key=str) == plain(relabelled(rows), lambda i: i % 100 == 0)


def test_query_against_sql(spark, tmp_path):
    rows = vectors(2, 900, 16)
    got = run(spark, tmp_path, rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(got) == sorted(con.sql(hn.OP11_SQL).fetchall()) and len(got) > 50


def test_blocks_of_any_size_give_the_same(spark, tmp_path, monkeypatch):
    rows = vectors(3, 700, 6, labels=3)
    want = sorted(run(spark, tmp_path, rows), key=str)
    for name, value in (("ROWS", 60), ("ANCHORS", 2), ("ROWS_HELD", 7), ("ANCHORS_HELD", 1), ("FEW", 1.0)):
        monkeypatch.setattr(hn, name, value)
    assert sorted(run(spark, tmp_path, rows), key=str) == want == plain(relabelled(rows), lambda i: i % 100 == 0)


@pytest.mark.parametrize("size", [3, 200, 10**6, 10**12])
def test_slices_of_small_and_large_integers(size):
    rng = np.random.default_rng(5)
    wrap = (lambda v: np.array([[int(c) for c in r] for r in v], object)) if size > 10**9 else (lambda v: v)
    x, a = wrap(rng.integers(-size, size, (300, 9))), wrap(rng.integers(-size, size, (4, 9)))
    x[100:110] = x[0:10]
    ids = rng.permutation(300)
    exact = [[sum(int(p) * int(q) for p, q in zip(u, v, strict=True)) for v in x] for u in a]
    tops = [sorted(row)[-20] for row in exact]
    low, high = (np.array([[f(t), f(t) * 2] for t in tops], object) for f in (lambda t: t * 4 // 5, lambda t: t))
    for window in ((low, high), (np.full((4, 2), -np.inf), np.full((4, 2), np.inf))):
        i, w, j, s = hn.sliced_best(a, x, np.ones((4, 300), bool), *window, np.full((4, 2), -np.inf, object), ids, 5)
        got = [(int(p), int(q), int(ids[r]), int(v)) for p, q, r, v in zip(i, w, j, s, strict=True)]
        want = []
        for p in range(4):
            for q in range(2):
                fit = sorted((-exact[p][r], int(ids[r])) for r in range(300) if window[0][p, q] <= exact[p][r] <= window[1][p, q])[:5]
                want += [(p, q, r, -v) for v, r in fit]
        assert sorted(got) == sorted(want)


def test_candidates_are_dropped_before_their_last_plane(monkeypatch):
    seen = []
    bits = hn._bits
    monkeypatch.setattr(hn, "_bits", lambda x, b, kind: seen.append(b) or bits(x, b, kind))
    rng = np.random.default_rng(6)
    x, a = rng.integers(-100, 100, (4000, 64)), rng.integers(-100, 100, (2, 64))
    calls = []
    real = hn._raise
    monkeypatch.setattr(hn, "_raise", lambda least, group, value, most: calls.append(len(group)) or real(least, group, value, most))
    hn.sliced_best(a, x, np.ones((2, 4000), bool), np.full((2, 1), -np.inf), np.full((2, 1), np.inf), np.full((2, 1), -np.inf, object), np.arange(4000), 5)
    assert seen == sorted(seen, reverse=True) and calls and calls[0] < 700 and calls[-1] < 60


def test_extremes_and_empty_tables(spark):
    shape = "vec_id long, embedding array<double>, label int, name string, part int"
    big = [(0, [1e18, 1.0], 1), (1, [1e18, 0.0], 1), (2, [9e17, 0.0], 2), (3, [1e18, 0.0], 2), (4, [-1e30, 1e-300], 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in big], shape)
    got = sorted(map(tuple, hn.hard_negatives(df, F.col("vec_id") == 0).collect()))
    assert [(r[1], r[3], r[4]) for r in got] == [(1, 2, hn.NO_ID), (1, 3, hn.NO_ID)]
    assert hn.hard_negatives(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert hn.hard_negatives(df, F.col("vec_id") == 77).count() == 0
    alone = hn.hard_negatives(df.where("vec_id <> 1"), F.col("vec_id") == 0)
    assert alone.count() == 0 and alone.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
