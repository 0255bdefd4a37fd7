import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from provenia.llm import packing


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def texts(n=120):
    rng = random.Random(10)
    parts = ["Word", "the", " ", "  ", "\n", "'s", "'re", "é", "é", "日本", "12", "!?", ". ", "<|endoftext|>", "\x1c", "\x85", " ", "ΣΑΣ", "İ", "ABC. "]
    return ["", " ", "Hello, World. It's", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 80))) for _ in range(n))]


def test_ids_are_the_library_s(library, monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 50)
    encoder = packing.WordEncoder("word_bpe_49k.json")
    all_of = [*texts(), "Ann ann, ANN! Ænn\u00df \u0130x aaaaaaaaa -- a\u0301 x'S (a) a.b"]
    for k in range(0, len(all_of), 5):
        for t, got in zip(all_of[k : k + 5], encoder.encode(all_of[k : k + 5])):
            assert got.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_plain_words_are_merged_once_without_the_library_and_leave_nothing(library, monkeypatch):
    encoder = packing.WordEncoder("word_bpe_49k.json")
    monkeypatch.setattr(encoder, "library", None)
    merge, merged = encoder.merges.merge, []
    monkeypatch.setattr(encoder.merges, "merge", lambda ids, sizes: merged.append(len(sizes)) or merge(ids, sizes))
    some = ["The THE (the) the. the", "3.14 well-known é,É ÿ", "", "a<|b|>c 2024/11"]
    for t, got in zip(some, encoder.encode(some), strict=True):
        assert got.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    assert merged == [len({"the", "(", ")", ".", *"314202411", "well", "-", "known", "é", ",", "ÿ", "a", "<|", "b", "|>", "c", "/"})]
    rng = random.Random(29)
    words = ["".join(rng.choices("abcdefghé", k=9)) for _ in range(20_000)]
    encoder.encode([" ".join(words)])
    assert not encoder.young and not encoder.old


def test_any_neighbours_give_the_library_s_ids(library, monkeypatch):
    monkeypatch.setattr(packing, "TOGETHER", 40)
    encoder = packing.WordEncoder("word_bpe_49k.json")
    rng = random.Random(31)
    parts = [*map(chr, range(256)), "\u0301", "<", "\u0338", "<|startoftext|>", "<|ENDOFTEXT|>", "oftext|>", "\u3000", "\u2028", "\u212a", "\u0130", "\u03a3", "日本", "\U0001d400", "'ll", "word", "q" * 70, "!" * 70]
    many = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(2000)]
    for k in range(0, len(many), 40):
        for t, got in zip(many[k : k + 40], encoder.encode(many[k : k + 40]), strict=True):
            assert got.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    for t in filter(None, many[:300]):
        assert encoder.encode_long(t.encode()).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def slow_cost(pos, pen, size):
    pos, pen = [0, *pos], [0, *pen]
    best = [0] + [None] * (len(pos) - 1)
    for j in range(1, len(pos)):
        best[j] = min(best[i] + size - (pos[j] - pos[i]) + pen[j] for i in range(j) if pos[j] - pos[i] <= size)
    return best[-1]


def test_cuts_are_the_cheapest():
    rng = random.Random(11)
    for _ in range(60):
        pos = np.cumsum([rng.randint(1, 8) for _ in range(rng.randint(1, 60))])
        pen = np.array([rng.choice([0, 3, 9]) for _ in pos])
        cuts = packing.choose_cuts(pos, pen, 16)
        of = dict(zip(pos.tolist(), pen.tolist()))
        assert cuts[-1] == pos[-1]
        assert sum(16 - (b - a) + of[b] for a, b in zip([0, *cuts], cuts)) == slow_cost(pos.tolist(), pen.tolist(), 16)


@pytest.mark.parametrize("block", [200, 1 << 18])
def test_pieces_cover_every_id(spark, library, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    long = "abc. def " * 900
    rows = [(i, t, 5) for i, t in enumerate(texts(40))] + [(500, long, 5), (501, None, 5), (None, "x", 5), (0, "", 5), (502, "q" * 9000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int").coalesce(2)
    got = packing.pack(docs, size=256).collect()
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        ids = want[i][0]
        assert sum(p.length for p in pieces) == sum(map(len, want[i]))
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            if len(want[i]) == 1:
                assert p.start == at
            at = p.start + p.length
            assert p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : at], "<u4").tobytes())
    total = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
        total += at
    assert total == sum(len(x) for v in want.values() for x in v)
    assert total > 0.9 * 256 * (len(by_seq) - 2)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks_cost_little_more_than_the_whole(monkeypatch):
    rng = np.random.default_rng(23)
    stops = np.zeros(50, bool)
    stops[:2] = True
    docs = [rng.integers(0, 50, rng.integers(20, 900)).astype("<u4") for _ in range(1500)]
    monkeypatch.setattr(packing, "BLOCK", 20_000)
    packer = packing.Packer(stops, 256)
    out = [piece for i, ids in enumerate(docs) for piece in packer.add(i, ids)] + packer.finish()
    at, pen = packer._candidates(np.concatenate(docs), np.cumsum([len(x) for x in docs]))
    of = dict(zip(at.tolist(), pen.tolist()))
    sizes = {}
    for piece in out:
        sizes[piece[5]] = sizes.get(piece[5], 0) + piece[2]
    cost = lambda cuts: sum(256 - (b - a) + of.get(b, packing.WITHIN) for a, b in zip([0, *cuts], cuts))
    best = packing.choose_cuts(at, pen, 256)
    got = np.cumsum([sizes[k] for k in sorted(sizes)]).tolist()
    assert len(got) <= len(best) * 1.002 + 1, (len(got), len(best))
    assert cost(got) <= 1.1 * cost(best), (cost(got), cost(best))
