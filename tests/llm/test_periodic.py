import hashlib
import random
import re
import zlib
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from provenia.llm import periodic


def plain_runs(words, times=4, least=6):
    """By definition: each period, each stretch on which words that far apart agree; smallest periods only."""
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            if length >= max(least, times * q) and all(any(words[s + k] != words[s + k + d] for k in range(length - d)) for d in range(1, q)):
                found.append((s, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_planted(words, doc_id):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    words = words if doc_id is None else plain_planted(words, doc_id)
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[0] if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.sampled_from([(4, 6), (2, 2), (3, 5), (2, 6)]))
def test_runs_of_small_alphabets(words, limits):
    assert periodic.automaton_runs(words, *limits) == plain_runs(words, *limits)
    assert periodic.word_runs([b"%d" % w for w in words], *limits) == plain_runs(words, *limits)


def test_runs_made_of_repeated_pieces():
    rng = random.Random(13)
    for _ in range(300):
        words = []
        while len(words) < 120:
            piece = [rng.randrange(6) for _ in range(rng.randint(1, 9))]
            words += piece * rng.randint(1, 6) + piece[: rng.randrange(len(piece) + 1)]
        assert periodic.word_runs([b"%d" % w for w in words]) == plain_runs(words)
    assert periodic.word_runs([b"a"] * 5) == [] and periodic.word_runs([b"a"] * 6) == [(0, 6, 1)]
    assert periodic.word_runs([b"a", b"b"] * 3) == [] and periodic.word_runs([b"a", b"b"] * 4) == [(0, 8, 2)]


def test_large_sets_of_positions_are_merged(monkeypatch):
    words = [random.Random(1).randrange(2) for _ in range(40)] * 30 + [0, 1] * 200 + [1] * 50
    want = plain_runs(words)
    for few in (0, 1000):
        monkeypatch.setattr(periodic, "FEW", few)
        assert periodic.word_runs([b"%d" % w for w in words]) == want


def test_stretches_leave_prose_out_and_keep_runs():
    import numpy as np

    rng = random.Random(4)
    prose = [rng.randrange(500) for _ in range(3000)]
    words = np.array(prose[:1000] + [7, 8, 9] * 6 + prose[1000:])
    found = periodic.stretches(words)
    assert any(a <= 1000 and b >= 1018 for a, b in found) and sum(b - a for a, b in found) < 60
    assert periodic.stretches(np.zeros(0, np.int64)) == []
    wide = np.array([3_000_000_000, 1, 2, 3] * 5)  # keys of grams that would not fit 64 bits
    assert periodic.stretches(wide) == [(0, 20)]


def test_a_long_text_takes_near_linear_time():
    import time

    rng = random.Random(3)
    piece = [b"%d" % rng.randrange(5000) for _ in range(7000)]
    began = time.time()
    assert periodic.word_runs(piece * 10) == [(0, 70000, 7000)]
    assert time.time() - began < 30


def test_query_against_plain_version(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        words = [rng.choice(["la", "le", "li", "lo", "é", "x\u0085y", "ß."]) for _ in range(rng.choice([0, 1, 5, 30, 150]))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words), "a"))
    rows += [(500, None, "a"), (501, "", None), (502, " \n ", "b"), (None, "a b " * 9, "b"), (3, rows[3][1], "c"), (3, rows[3][1], "c"), (504, "boiler plate line\n" * 40, "d")]
    rows += [(i, "ein wort noch eines mehr " * 12, "e") for i in range(600, 640)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in periodic.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((plain_row(i, t) for i, t, _ in rows), key=str)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_operator_names_and_limits(spark):
    docs = spark.createDataFrame([("k1", "a a a b", 1), (None, "c c c c", 2)], "key string, body string, n_runs int")
    got = periodic.periodic_runs(docs, "key", "body", times=3, least=3)
    assert got.columns[0] == "key" and sorted((r.key or "", r.n_runs, r.length) for r in got.collect()) == [("", 1, 4), ("k1", 1, 3)]
