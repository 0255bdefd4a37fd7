import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from provenia.llm import simhash


def slow_fingerprint(text, words=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, bits=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprint_matches_plain_version(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = random.Random(1)
    texts = ["", " \n", "one", "One two", "a b c", "ÄÉ b c d\x1ce f\x85g", "x" * 200, "x" * 100 + " y " + "z" * 100]
    texts += ["".join(rng.choice(["ab", "C", " ", "\n", "é", "\t", "dd "]) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == slow_fingerprint(t), repr(t)


def test_trie_join_finds_each_link(monkeypatch):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:40]:
        for _ in range(6):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 5)):
                g ^= 1 << b
            fps.add(g)
    fps = np.array(sorted(fps), np.uint64)
    want = slow_components([int(x) for x in fps])
    for frontier in (1 << 18, 64):
        monkeypatch.setattr(simhash, "FRONTIER", frontier)
        assert simhash.trie_links(np.zeros(len(fps), np.int64), fps).tolist() == want


def test_wide_trie_join(monkeypatch):
    rng = random.Random(4)
    fps = {rng.getrandbits(128) for _ in range(60)}
    for f in list(fps)[:25]:
        for _ in range(5):
            g = f
            for b in rng.sample(range(128), rng.randint(1, 9)):
                g ^= 1 << b
            fps.add(g)
    ordered = sorted(fps)
    words = np.array([[f >> 64, f & (2**64 - 1)] for f in ordered], np.uint64)
    for frontier in (1 << 18, 50):
        monkeypatch.setattr(simhash, "FRONTIER", frontier)
        assert simhash.trie_links(np.zeros(len(words), np.int64), words, 7).tolist() == slow_components(ordered, 7)


def test_near_copies_of_long_texts_go(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice(["ta", "ri", "no", "se", "lu", "ke"]) for _ in range(rng.randint(1, 5))) for _ in range(3000)]
    base = [[rng.choice(words) for _ in range(rng.randint(80, 400))] for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(30):
        w = list(base[i])
        for k in rng.sample(range(len(w)), max(1, len(w) // 45)):
            w[k] = rng.choice(words)
        rows.append((100 + i, " ".join(w)))
    rows += [(200, "Tiny text"), (201, "tiny TEXT"), (202, "tiny book"), (203, ""), (204, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    assert set(range(60)) <= kept and len(kept & set(range(100, 130))) <= 1
    assert {200, 202, 203} <= kept and not kept & {201, 204}


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_brute_force(rows, least=0.8):
    """Ids that stay if texts link whose five-word fingerprints differ in as many bits as cosine `least` has."""
    fps = [np.frombuffer(simhash.wide_fingerprint(simhash.shingle_set((t or "").encode()))[0], np.uint64) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for j, b in enumerate(fps[:i]):
            if int(np.bitwise_count(a ^ b).sum()) <= simhash.budget(least):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {k for i, (k, _) in enumerate(rows) if find(i) == i}


def cosine(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / max(1, len(a) * len(b)) ** 0.5


def vocabulary(rng, n=3000):
    return ["".join(rng.choice(["ta", "ri", "no", "se", "lu", "ke"]) for _ in range(rng.randint(1, 5))) + str(i) for i in range(n)]


def test_near_copies_with_block_edits_go(spark):
    rng = random.Random(6)
    words = vocabulary(rng)
    some = lambda n: [rng.choice(words) for _ in range(n)]
    rows, copies = [], []
    for i in range(40):
        w = some(rng.randint(60, 600))
        k, at = (len(w) - 4) // 5 - 8, rng.randrange(len(w))
        made = [w + some(k), w[k:], w[:-k], w[:at] + some(k) + w[at:]]
        rows.append((i, " ".join(w)))
        rows.append((1000 + i, " ".join(made[i % 4])))
        copies.append(1000 + i)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    assert not kept & set(copies) and kept == kept_by_brute_force(rows)


def test_texts_below_the_threshold_stay(spark):
    rng = random.Random(7)
    words = vocabulary(rng)
    rows = []
    for i in range(20):
        w = rng.sample(words, 150)
        edited = list(w)
        for k in range(5, 150, 15):
            edited[k] = "changed"  # ten words: cosine 0.66
        turned = w[:]
        rng.shuffle(turned)
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(edited)), (10 * i + 2, " ".join(turned)), (10 * i + 3, " ".join(w + w[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == {i for i, _ in rows} == kept_by_brute_force(rows)


def passages(rng, n=60):
    words = vocabulary(rng, 400)
    shared = [[rng.choice(words) for _ in range(rng.randint(10, 50))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = sum(rng.sample(shared, rng.randint(1, 4)), []) + [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for j in range(rng.randint(1, 8)):
            v = list(w)
            for k in rng.sample(range(len(v)), rng.randint(0, len(v) // 25)):
                v[k] = rng.choice(words)
            rows.append((100 * i + j, " ".join(v[rng.randint(0, len(v) // 12) :])))
    return rows


def test_each_near_copy_is_found(spark, monkeypatch):
    rows = passages(random.Random(8))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = kept_by_brute_force(rows)
    for hot in (1000, 12):  # tries whole, and split by bits
        monkeypatch.setattr(simhash, "SPLIT_HOT", hot)
        assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == want


def test_case_and_punctuation_play_no_part():
    assert simhash.shingle_set(b"One two, three: four five!").tolist() == simhash.shingle_set(b"one TWO three four, five").tolist()
    assert len(simhash.shingle_set(b"!! ?")) == 1 and len(simhash.shingle_set(b" \n")) == 0


def test_fingerprints_estimate_the_cosine():
    rows = passages(random.Random(9), 25)
    fps = [np.frombuffer(simhash.wide_fingerprint(simhash.shingle_set(t.encode()))[0], np.uint64) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            want = 1 - np.arccos(min(1.0, cosine(rows[i][1], rows[j][1]))) / np.pi
            assert abs(1 - int(np.bitwise_count(fps[i] ^ fps[j]).sum()) / simhash.WIDE - want) < 0.08


def test_work_grows_with_the_rows(monkeypatch):
    """Node pairs walked, over tries as wide_links() makes them, for twice the texts three times."""
    work = []
    for n in (500, 1000, 2000, 4000):
        rng = np.random.default_rng(n)
        base = rng.integers(0, 2**63, (n // 10, 300)).astype(np.uint64)
        sets = [np.unique(np.r_[base[i // 10, rng.random(300) < 0.93], rng.integers(0, 2**63, 20).astype(np.uint64)]) for i in range(n)]
        made = [simhash.wide_fingerprint(s) for s in sets]
        tries = sorted((a, fp) for fp, anchors in made for a in anchors)
        fp = np.frombuffer(b"".join(f for _, f in tries), ">u8").astype(np.uint64).reshape(len(tries), -1)
        new = np.r_[True, [x != y for x, y in zip(tries, tries[1:])]]
        work.append(simhash.trie_walk(np.array([a for a, _ in tries])[new], fp[new], simhash.budget())[3])
    for a, b in zip(work, work[1:]):
        assert b <= 2.3 * a


def test_hot_tries_of_narrow_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 20)
    rng = random.Random(12)
    fps = {rng.getrandbits(16) << 48 | 7 << 16 | rng.getrandbits(16) for _ in range(150)}
    fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in list(fps)[:60]}
    fps = sorted(fps)
    rows = spark.createDataFrame([((f ^ (1 << 63)) - (1 << 63),) for f in fps], "fp long")
    place = {(f ^ (1 << 63)) - (1 << 63): k for k, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in simhash.near_links(rows).collect():
        a, b = sorted((find(place[r.u]), find(place[r.v])))
        root[b] = a
    assert [find(i) for i in range(len(fps))] == slow_components(fps)


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(rng.randint(4, 60))) for _ in range(40)]
    texts = base + [t.replace("aaa", "zzz", 1) for t in base] + base[:9] + ["", None, " \t", "same", "SAME"]
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [slow_fingerprint(t or "") for _, t, _ in rows]
    roots = slow_components(fps)
    low = {}
    for (i, _, _), r in zip(rows, roots):
        low[r] = min(i, low.get(r, i))
    assert got == sorted((i, f, low[r]) for (i, _, _), f, r in zip(rows, fps, roots))


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_fingerprints_stay_whole(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text of all rows").otherwise(F.concat(F.lit("row number "), F.sha2(F.col("id").cast("string"), 256))).alias("text"))
    got = simhash.near_duplicates(docs)
    assert got.count() == 3000
    assert got.where("component_id = 0").count() == 1000


def test_large_groups_of_near_copies_link_by_stars(spark, monkeypatch):
    """Tries whose rows are equal in whole blocks are not gathered: their rows link to the first one."""
    monkeypatch.setattr(simhash, "SPLIT_HOT", 6)
    rng = random.Random(33)
    base, other = rng.getrandbits(1024), rng.getrandbits(1024)
    flip = lambda x: x ^ sum(1 << b for b in rng.sample(range(64), 12))
    fps = [flip(base) for _ in range(40)] + [flip(other) for _ in range(30)] + [rng.getrandbits(1024) for _ in range(10)]
    rows = [(i, x.to_bytes(128, "big"), [1, 2 + (i % 2)]) for i, x in enumerate(fps)]
    marked = spark.createDataFrame(rows, "f long, fp binary, anchors array<long>")
    links = {(r.u, r.v) for r in simhash.wide_links(marked).collect()}
    root = list(range(80))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in links:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    assert [find(i) for i in range(80)] == [0] * 40 + [40] * 30 + list(range(70, 80))


def apart(rng, fp, bits):
    """fp with so many bits turned."""
    return fp ^ sum(1 << b for b in rng.sample(range(1024), bits))


def test_masks_cover_the_budget_at_each_size():
    """Of pairs at the budget as many meet in a trie of a thousand rows as in one of three hundred thousand."""
    rng = random.Random(41)
    for differ, least in ((180, 0.99), (210, 0.98), (simhash.budget(), 0.97)):
        first = [rng.getrandbits(1024) for _ in range(600)]
        rows = [x.to_bytes(128, "big") for f in first for x in (f, apart(rng, f, differ))]
        fp = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 128)
        for n in (1_001, 10_000, 300_000, 30_000_000):
            width = simhash.mask_width(n)
            meet, most = np.zeros(600, bool), 0
            for code in simhash.mask_codes(fp, width, simhash.covering(simhash.budget(), width)):
                meet |= code[::2] == code[1::2]
                most = max(most, np.bincount(code).max())
            assert meet.mean() >= least, (differ, n, meet.mean())
        assert n * 2**-width < 8 * simhash.SPLIT_HOT


def test_links_of_a_hot_trie_are_those_of_brute_force(spark, monkeypatch):
    """Chains whose ends are far apart, pairs near the budget, a dense group with rows at its edge, all in one trie."""
    monkeypatch.setattr(simhash, "SPLIT_HOT", 15)
    monkeypatch.setattr(simhash, "PACKED", 7)
    rng = random.Random(43)
    fps = [rng.getrandbits(1024) for _ in range(120)]
    for k in range(20):
        fps.append(apart(rng, fps[k], 215))
    for k in range(20, 26):
        end = fps[k]
        for _ in range(8):
            end = apart(rng, end, 110)
            fps.append(end)
    dense = [apart(rng, fps[30], 60) for _ in range(80)]
    fps += dense + [apart(rng, x, 205) for x in dense[:15]]
    order = rng.sample(range(len(fps)), len(fps))
    fps = [fps[k] for k in order]
    words = np.array([np.frombuffer(x.to_bytes(128, "big"), np.uint64) for x in fps])
    near = np.array([np.bitwise_count(words ^ w).sum(1) for w in words]) <= simhash.budget()

    def roots(links):
        root = list(range(len(fps)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for u, v in links:
            a, b = sorted((find(u), find(v)))
            root[b] = a
        return [find(i) for i in range(len(fps))]

    marked = spark.createDataFrame([(i, x.to_bytes(128, "big"), [1, 2]) for i, x in enumerate(fps)], "f long, fp binary, anchors array<long>").repartition(3)
    links = {(r.u, r.v) for r in simhash.wide_links(marked).collect()}
    assert all(near[u, v] for u, v in links)
    want = roots(zip(*np.nonzero(near)))
    found = roots(links)
    assert sum(found[i] == found[j] for i, j in zip(*np.nonzero(near))) >= 0.99 * near.sum()
    assert sum(a == b for a, b in zip(want, found)) >= len(fps) - 2


def test_links_do_not_depend_on_the_size_of_a_trie(spark, monkeypatch):
    """Pairs at the budget that share one shingle only, which all rows have: the same links whether that trie is small or large."""
    rng = random.Random(44)
    monkeypatch.setattr(simhash, "GRID", 30)
    first = [rng.getrandbits(1024) for _ in range(60)]
    fps = [x for f in first for x in (f, apart(rng, f, simhash.budget()))] + [rng.getrandbits(1024) for _ in range(40)]
    rows = [(i, x.to_bytes(128, "big"), [1, 100 + i]) for i, x in enumerate(fps)]
    marked = spark.createDataFrame(rows, "f long, fp binary, anchors array<long>").repartition(3)
    for hot in (1000, 20, 2):
        monkeypatch.setattr(simhash, "SPLIT_HOT", hot)
        assert {(min(r), max(r)) for r in simhash.wide_links(marked).collect()} == {(2 * i, 2 * i + 1) for i in range(60)}, hot


def test_pairs_of_blocks_are_those_of_brute_force(monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 7)
    rng = random.Random(45)
    a = [rng.getrandbits(1024) for _ in range(40)]
    b = [apart(rng, x, rng.randint(0, 446)) for x in a] + [x ^ (2**400 - 1) for x in a[:5]] + [x ^ (2**150 - 1) << 800 for x in a[:5]]
    words = [np.array([np.frombuffer(x.to_bytes(128, "big"), np.uint64) for x in y]) for y in (a, b)]
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (x ^ y).bit_count() <= 223}
    assert {(int(i), int(j)) for p, q in simhash.near_pairs(*words, 223) for i, j in zip(p, q)} == want


def test_scratch_tables_of_near_copies_are_few_files(spark, monkeypatch, tmp_path):
    """However many partitions a shuffle has, a scratch table of the stage is a file a core at most, large tries included."""
    monkeypatch.setattr(simhash, "SPLIT_HOT", 12)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    docs = spark.createDataFrame(passages(random.Random(8), 20), "doc_id long, text string").repartition(4)
    monkeypatch.setattr("provenia.llm.common.scratch_dir", lambda _: f"file://{tmp_path}/{len(list(tmp_path.iterdir()))}")
    monkeypatch.setattr("provenia.llm.components.remove", lambda _: None)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        simhash.drop_near_copies(docs).count()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert max(len(list(d.glob("*.parquet"))) for d in tmp_path.iterdir()) <= spark.sparkContext.defaultParallelism
