import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from provenia.llm import bpe


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return bpe.MergeList(path), library


def texts():
    rng = random.Random(7)
    parts = ["the", " ", "  ", "\n", "\n\n", " \n ", "'re", "'", "r", "e", "'s", "é", "日本", "123", "4", "!!", "<|endoftext|>", "<|endof", "\x1c", "\x85", "\xa0", "😀", "Straße", "\t", "aaaa", "-----", "=="]
    out = ["", " ", "   ", "hello world", " \n\n  x", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b"]
    out += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 200))) for _ in range(150)]
    return out


def test_matches_the_library(both):
    merges, library = both
    for t in texts():
        assert bpe.encode(merges, t) == library.encode(t, add_special_tokens=False).ids, repr(t)


def side_by_side(merges, each):
    got = [[] for _ in each]
    for step in bpe.encoded(merges, each, bpe.Memo(merges)):
        for ids, more in zip(got, step, strict=True):
            ids += more
    return got


def test_texts_side_by_side(both, monkeypatch):
    merges, library = both
    each = [*texts(), *texts(), " ".join(texts()) * 3]
    want = [library.encode(t, add_special_tokens=False).ids for t in each]
    assert side_by_side(merges, each) == want
    monkeypatch.setattr(bpe, "BLOCK", 25)
    assert side_by_side(merges, each) == want
    assert list(bpe.encoded(merges, [], bpe.Memo(merges))) == [[]]


def test_documents_go_through_the_transducer(both, monkeypatch):
    """Each text of ordinary size is fed to its own transducer, and a long one is settled while it is fed."""
    merges, library = both
    fed, held = [], []
    feed = bpe.StreamEncoder.feed

    def counted(self, text):
        out = feed(self, text)
        fed.append((id(self), len(text), bool(out)))
        held.append(len(self.buffer))
        return out

    monkeypatch.setattr(bpe.StreamEncoder, "feed", counted)
    word = "some words of a text, as they come: 12 of them\n"
    each = [word * n for n in (1, 5, 40, 400, 4000)]
    assert side_by_side(merges, each) == [library.encode(t, add_special_tokens=False).ids for t in each]
    assert {n for _, n, _ in fed} >= {len(word), 5 * len(word), 40 * len(word), bpe.BLOCK}
    assert len({i for i, *_ in fed}) == 5 and sum(out for *_, out in fed) > 10
    assert max(held) < 2 * bpe.BLOCK


def test_streaming_gives_the_same_ids(both, monkeypatch):
    merges, library = both
    rng = random.Random(8)
    monkeypatch.setattr(bpe, "BLOCK", 30)
    monkeypatch.setattr(bpe, "WINDOW", 40)
    long = ["a" * 5000, "".join(rng.choice("abehinorst") for _ in range(4000)), " " * 3000 + "x", " " * 900, "\n" * 500 + " y", "-=" * 2000, "!" * 700 + "'re", "9" * 800 + "<|endoftext|>" + "z" * 400, "é" * 900, " " * 400 + "<|endoftext|>"]
    for t in texts()[:60] + long:
        want = library.encode(t, add_special_tokens=False).ids
        assert bpe.encode(merges, t) == want, repr(t[:80])
        for _ in range(2):
            stream, got, at = bpe.StreamEncoder(merges), [], 0
            while at < len(t):
                step = rng.randint(1, 50)
                got += stream.feed(t[at : at + step])
                assert len(stream.buffer) < 4 * bpe.BLOCK and (stream.run is None or len(stream.run.held) < bpe.WINDOW + merges.lookahead + 1)
                at += step
            memo = bpe.Memo(merges)
            flat = [i for x in got + stream.finish() for i in (memo.ids([bpe._OUTER.findall(x)])[0] if isinstance(x, str) else [x])]
            assert flat == want, repr(t[:80])


def test_lookahead_bounds_changes(both):
    merges, _ = both
    rng = random.Random(9)
    assert 128 < merges.lookahead < 100_000
    for letters in ("ab", "-=", "a", "ehinorst"):
        data = "".join(rng.choice(letters) for _ in range(merges.lookahead + 3000)).encode()
        stream = bpe.PretokenStream(merges)
        assert stream.feed(data) + stream.finish() == merges.merge(data)


def test_decoder_waits_for_whole_characters(both):
    merges, library = both
    t = "日本😀é <|endoftext|> x"
    ids = bpe.encode(merges, t)
    decoder = bpe.StreamDecoder(merges)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == t
    odd = ids[:3] + ids[1:2] + ids[-4:]
    decoder = bpe.StreamDecoder(merges)
    assert decoder.feed(odd) + decoder.finish() == library.decode(odd, skip_special_tokens=False)


def test_query_rows(spark, both):
    _, library = both
    rows = [(i, t, "n") for i, t in enumerate(texts()[:40])] + [(99, None, "n"), (0, "", "n"), (None, "x", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)

    def want(i, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert sorted(map(tuple, bpe.round_trip(docs).collect()), key=str) == sorted((want(i, t) for i, t, _ in rows), key=str)
    assert bpe.round_trip(docs.limit(0)).count() == 0
