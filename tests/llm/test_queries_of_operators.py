"""Whole queries, as they are registered, against plain versions over one small table with odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from provenia.llm import registry
from tests.llm.test_simhash import slow_components, slow_fingerprint


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(77)
    words = ["ta", "rino", "selu", "éclair", "über", "niño", "x1", "$", "idea", "word"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40, 200])))) for i in range(90)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, rows[5][1]), (5, rows[5][1]), (104, "long " * 6000), (105, "Ω≈ç√ 🙂   end")]
    root = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(root / "documents.parquet"))
    return str(root), rows


def run(spark, made, name):
    return registry.QUERIES[name](spark, made[0]).collect()


def test_op3(spark, made):
    rows = made[1]
    fps = [slow_fingerprint(t or "") for _, t in rows]
    low = {}
    roots = slow_components(fps)
    for (i, _), r in zip(rows, roots, strict=True):
        low[r] = min(i, low.get(r, i))
    assert sorted(map(tuple, run(spark, made, "op3_simhash"))) == sorted((i, f"{f:016x}", low[r]) for (i, _), f, r in zip(rows, fps, roots, strict=True))


def test_op7(spark, made):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.no_padding()
    whole.no_truncation()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in made[1]:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(whole.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, run(spark, made, "op7_bpe"))) == sorted(want)


def test_op8(spark, made):
    got = run(spark, made, "op8_sharding")
    want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in made[1])
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None} and all(0 <= r.shard <= 15 for r in got)
    slots, shards = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        shards[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shards.values())


def test_op10(spark, made):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole.no_padding()
    whole.no_truncation()
    got = run(spark, made, "op10_packing")
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in made[1]}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    copies = {i: [x for x, _ in made[1]].count(i) for i in ids}
    for i, own in pieces.items():
        assert sum(n for _, n in own) == copies[i] * len(ids[i]) and sorted(own)[0][0] == 0
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at <= 2048
    assert set(pieces) == set(ids)
