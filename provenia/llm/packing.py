"""Documents packed in their order into sequences of fixed length, cut where it costs least.

Each run of documents (a task's share of the input, in its order) is one stream of ids.
Windows of at most `size` ids cover it. A window costs its padding plus a penalty for
where it ends: nothing at the end of a document, little at the end of a sentence, more
elsewhere. With f[j] the least cost of the stream up to the candidate cut j,

    f[j] = penalty[j] + size - pos[j] + min { f[i] + pos[i] : pos[j] - pos[i] <= size },

and the minimum over a sliding range of i comes from a monotone queue, so a run takes
time linear in its candidates. The stream is solved block by block: the last windows of
a block are taken back and solved again with the next, so memory stays bounded.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provenia.llm.bpe import byte_letters
from provenia.llm.common import turn_to
from provenia.llm.merging import MergeTable

#: Ids of a sequence; id after each document.
SIZE, END = 2048, 1
#: Penalties of a cut at the end of a sentence and within one; ids between candidates within one.
SENTENCE, WITHIN, STEP = 4, 12, 24
#: Ids of a block, and windows at its end that are solved again with the next.
BLOCK, AGAIN = 1 << 19, 4
#: Entries of a generation of the memo of words that the library splits; bytes of the longest word merged or kept there; bytes of texts encoded together.
MEMO, KEY, TOGETHER = 150_000, 64, 1 << 21
#: Kinds of bytes. Runs of letters and of marks and single digits are pre-tokens; of a word with any other byte the library decides.
_GAP, _LETTER, _MARK, _DIGIT, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[list(b"\t\n\x0b\x0c\r ")] = _GAP
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = _LETTER
_KIND[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = _MARK
_KIND[list(b"0123456789")] = _DIGIT
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Second bytes, after C3, of the letters of Latin-1 (not of \u00d7 and \u00f7), and the same in lower case.
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
_SECOND_LOWER = np.arange(256, dtype=np.uint8)
_SECOND_LOWER[0x80:0x9F] += 0x20
#: The end of the tokenizer's special tokens, which are no words of marks and letters.
_SPECIAL = re.compile(rb"oftext\|>")
_BREAK = re.compile(rb"[\t-\r ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class WordEncoder:
    """ids of texts by a BPE tokenizer for which white space only separates words.

    Texts are read side by side as arrays of bytes. Words of Latin-1 letters, digits and
    ASCII marks but the apostrophe are split there into pre-tokens, of which each different
    one is merged once for these texts; nothing is kept of them. Any other word goes whole
    to the library, by a memo of two generations.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        path = public_tokenizers.path(vocabulary)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = sorted(byte_letters().items(), key=lambda x: x[1])
        self.inner = np.array([vocab[c] for c, _ in letters])
        self.final = np.array([vocab[c + suffix] for c, _ in letters])
        self.merges = MergeTable({(vocab[x], vocab[y]): (rank, vocab[x + y]) for rank, (x, y) in enumerate(model["merges"])})
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        stops = [i for t, i in self.library.get_vocab().items() if re.fullmatch(r"(?:.*[^\w\s])?[.!?]+[^\w\s]*</w>", t)]
        self.sentence_end = np.zeros(self.library.get_vocab_size(), bool)
        self.sentence_end[stops] = True

    def _by_library(self, words: list[bytes]) -> list[np.ndarray]:
        young, old = self.young, self.old
        got = {w: old.get(w) if (b := young.get(w)) is None else b for w in words}
        new = [w for w, b in got.items() if b is None]
        if new:
            encoded = self.library.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
            got.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(new, encoded, strict=True))
        fresh = {w: b for w, b in got.items() if len(w) <= KEY and w not in young}
        if len(young) + len(fresh) > MEMO:
            self.old, self.young = young, {}
        self.young.update(fresh)
        return [np.frombuffer(got[w], "<u4") for w in words]

    def _encoded(self, words: pa.BinaryArray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of different words laid end to end, and how many each has; those marked in whole go to the library."""
        n = len(words)
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset :][: n + 1].astype(np.int64)
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        sizes, last = np.diff(ends), ends[1:] - ends[0] - 1
        whole = whole | (sizes > KEY)
        ids = self.inner[raw]
        ids[last] = self.final[raw[last]]
        some = np.flatnonzero(whole)
        if not len(some):
            return self.merges.merge(ids, sizes)
        ids, of_plain = self.merges.merge(ids[np.repeat(~whole, sizes)], sizes[~whole])
        rest = self._by_library(words.take(pa.array(some)).to_pylist())
        counts = np.zeros(n, np.int64)
        counts[~whole] = of_plain
        counts[some] = [len(x) for x in rest]
        out, of_rest = np.empty(counts.sum(), np.int64), np.repeat(whole, counts)
        out[~of_rest] = ids
        out[of_rest] = np.concatenate(rest)
        return out, counts

    def encode(self, texts: list[str] | list[bytes]) -> list[np.ndarray]:
        """ids of each text (str or its UTF-8)."""
        data = [t.encode() if isinstance(t, str) else t for t in texts]
        text_ends = np.cumsum([len(t) + 1 for t in data])
        joined = b"\n".join([*data, b""])
        raw = np.frombuffer(joined, np.uint8)
        kind, low = _KIND[raw], _LOWER[raw]
        latin = np.flatnonzero(raw == 0xC3)
        latin = latin[_SECOND[raw[latin + 1]]]
        kind[latin] = kind[latin + 1] = _LETTER
        low[latin + 1] = _SECOND_LOWER[raw[latin + 1]]
        kind[[m.start() for m in _SPECIAL.finditer(joined)]] = _OTHER
        solid = kind != _GAP
        if (kind == _OTHER).any():  # their words stay whole and as they are
            word = np.cumsum(solid & ~np.r_[False, solid[:-1]], dtype=np.int32)
            odd = np.zeros(word[-1] + 1, bool)
            odd[word[kind == _OTHER]] = True
            inside = odd[word] & solid
            kind[inside], low[inside] = _OTHER, raw[inside]
        first = solid & ((np.r_[np.uint8(_GAP), kind[:-1]] != kind) | (kind == _DIGIT))
        at = np.flatnonzero(first)
        if not len(at):
            return [np.zeros(0, "<u4")] * len(data)
        packed = low[solid]
        offsets = np.r_[np.flatnonzero(first[solid]), len(packed)].astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
        index = words.indices.to_numpy()
        whole = np.zeros(len(words.dictionary), bool)
        whole[index[kind[at] == _OTHER]] = True
        ids, counts = self._encoded(words.dictionary, whole)
        before = np.cumsum(counts) - counts
        n = counts[index]
        ends = np.cumsum(n)
        out = ids.astype("<u4")[np.repeat(before[index] - (ends - n), n) + np.arange(ends[-1])]
        cuts = np.r_[0, ends][np.searchsorted(at, text_ends)].tolist()
        return [out[a:b] for a, b in zip([0, *cuts], cuts)]

    def encode_long(self, text: bytes) -> np.ndarray:
        """ids of a UTF-8 text of any length, a block of words at a time."""
        parts, at = [], 0
        while at < len(text):
            gap = _BREAK.search(text, at + TOGETHER) if len(text) - at > TOGETHER else None
            end = gap.start() if gap else len(text)
            parts += self.encode([text[at:end]])
            at = end
        return np.concatenate(parts)


@functools.lru_cache(maxsize=2)
def encoder_of(vocabulary: str) -> WordEncoder:
    """One encoder for each Python worker, so that its memo outlives a task."""
    return WordEncoder(vocabulary)


def choose_cuts(positions: np.ndarray, penalties: np.ndarray, size: int = SIZE, more: bool = False) -> list[int]:
    """Positions at which the windows of the cheapest cover end; the last candidate is the stream's end.

    more: the stream goes on, so its last window stays open and its padding counts for
    nothing; of the cuts it can begin at that of least cost stands, less what the ids
    before it cost on average.
    """
    pos, pen = [0, *positions.tolist()], [0, *penalties.tolist()]
    cost, back = [0] * len(pos), [0] * len(pos)
    queue = deque([(0, 0, 0)])  # (cost + position, position, index), smallest first
    for j in range(1, len(pos)):
        p = pos[j]
        while p - queue[0][1] > size:
            queue.popleft()
        key, _, back[j] = queue[0]
        cost[j] = c = key + size - p + pen[j]
        c += p
        while queue and queue[-1][0] >= c:
            queue.pop()
        queue.append((c, p, j))
    cuts, j = [], len(pos) - 1
    if more:
        rate = cost[j] / max(1, pos[j])
        first = bisect_left(pos, pos[j] - size)
        j = min(range(first, j + 1), key=lambda i: cost[i] - rate * pos[i])
    while j:
        cuts.append(pos[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """Takes documents in order and gives their pieces, sequence after sequence."""

    def __init__(self, sentence_end: np.ndarray, size: int = SIZE):
        self.sentence_end, self.size = sentence_end, size
        self.held: list[tuple] = []  # (row, ids, ids before, ids of the document)
        self.length, self.sequence = 0, 0

    def add(self, row, ids: np.ndarray) -> list[tuple]:
        self.held.append((row, ids, 0, len(ids)))
        self.length += len(ids)
        return self._solve(False) if self.length >= BLOCK else []

    def finish(self) -> list[tuple]:
        return self._solve(True) if self.length else []

    def _candidates(self, stream: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        penalty = np.full(len(stream) + 1, 255, np.uint8)
        penalty[1:][self.sentence_end[stream]] = SENTENCE
        penalty[ends] = 0
        known = np.flatnonzero(penalty < 255)
        starts = np.r_[0, known[:-1]]
        gaps = (known - starts - 1) // STEP  # candidates at even steps where these lie far apart
        wide = gaps > 0
        if wide.any():
            n = gaps[wide]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
            penalty[np.repeat(starts[wide], n) + within * STEP] = WITHIN
        at = np.flatnonzero(penalty < 255)
        return at, penalty[at]

    def _solve(self, last: bool) -> list[tuple]:
        stream = np.concatenate([h[1] for h in self.held])
        ends = np.cumsum([len(h[1]) for h in self.held])
        cuts = choose_cuts(*self._candidates(stream, ends), self.size, not last)
        if not last:
            cuts = cuts[:-AGAIN]
        out, at, k, begin = [], 0, 0, 0
        for cut in cuts:
            offset = 0
            while at < cut:
                row, ids, before, total = self.held[k]
                to = min(cut, int(ends[k]))
                part = ids[at - begin : to - begin]
                out.append((row, before + at - begin, to - at, zlib.crc32(part.tobytes()), total, self.sequence, offset))
                offset, at = offset + to - at, to
                if at == ends[k]:
                    k, begin = k + 1, at
            self.sequence += 1
        rest = self.held[k:]
        if rest and at > begin:
            row, ids, before, total = rest[0]
            rest[0] = (row, ids[at - begin :], before + at - begin, total)
        self.held, self.length = rest, len(stream) - at
        return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", size: int = SIZE, end: int = END) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of docs gives the ids of its text and then the end id; a null or empty text
    gives the end id alone. Repeated rows are packed each on their own. An empty table
    gives no pieces. A sequence holds pieces of one task's documents, in their order;
    sequence ids are unique, not consecutive. Other columns play no part.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    schema = StructType().add(source.schema["id"])
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(encoder_of)
        encoder = encoder_of(vocabulary)
        packer = Packer(encoder.sentence_end, size)
        base = TaskContext.get().partitionId() << 33
        tail = np.array([end], "<u4")

        def rows(pieces: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True))
            arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:5]), pa.array([base + s for s in columns[5]], pa.int64()), pa.array(columns[6], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            rows_of, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes, at = pc.binary_length(texts).to_pylist(), 0
            while at < len(sizes):
                to, room = at + 1, TOGETHER - sizes[at]
                while to < len(sizes) and room > sizes[to]:
                    room -= sizes[to]
                    to += 1
                some = texts.slice(at, to - at).to_pylist()
                for i, ids in zip(rows_of[at:to], encoder.encode(some) if sizes[at] <= TOGETHER else [encoder.encode_long(some[0])], strict=True):
                    if pieces := packer.add(i, np.concatenate([ids, tail])):
                        yield rows(pieces, kind)
                at = to
        if pieces := packer.finish():
            yield rows(pieces, kind)

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: the pieces of all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
