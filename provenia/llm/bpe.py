"""Byte-level BPE as a streaming transducer, and its inverse.

Text goes in piece by piece. What can no longer change is encoded at once: a piece of
text up to a border between a visible character and white space, which no pre-token
crosses; without such a border, all pre-tokens but the last; and of a pre-token longer
than the window, the tokens that end further from its known end than the merge list's
sufficient lookahead. So memory is bounded by the window, whatever the text.

The lookahead: bytes appended to a string change its tokens from the right. A merge that
they cause or prevent can cause or prevent one on its left only if that comes later in
the merge list and its right part begins with the left part of the former. The longest
such chain, in bytes, is found in one pass over the merge list from its end.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from provenia.llm.common import text_pass
from provenia.llm.merging import MergeTable

#: Characters of text fed at a time, bytes of a pre-token that are settled at once.
BLOCK, WINDOW = 1 << 14, 1 << 9
#: Entries of a generation of the memo and their longest key.
MEMO, KEY = 300_000, 64
#: White space as Unicode has it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_OUTER = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_EDGE = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
_INNER = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_RUN = {"L": regex.compile(r"\p{L}+"), "N": regex.compile(r"\p{N}+"), "P": regex.compile(rf"[^{WHITE}\p{{L}}\p{{N}}]+"), "S": regex.compile(f"[{WHITE}]+")}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class MergeList:
    """Vocabulary and ranked merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.bytes = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes[i] = content.encode()
        self.of_byte = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(spec["model"]["merges"])}
        self.table = MergeTable(self.merges)
        self.byte_ids = np.array(self.of_byte)
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        longest, chain, most = max(map(len, self.bytes)), {}, 0
        for (a, b), _ in sorted(self.merges.items(), key=lambda x: -x[1][0]):
            left, right = self.bytes[a], self.bytes[b]
            n = len(left) + chain.get(left, 0)
            most = max(most, n)
            for k in range(1, len(right) + 1):
                if chain.get(right[:k], 0) < n:
                    chain[right[:k]] = n
        return most + longest

    def merge(self, data: bytes) -> list[int]:
        """Tokens of one pre-token: always the merge of lowest rank, the leftmost first."""
        ids = [self.of_byte[b] for b in data]
        if len(ids) > 64:
            return self._merge_long(ids)
        get = self.merges.get
        while len(ids) > 1:
            found = [get(p) for p in zip(ids, ids[1:])]
            ranks = [f for f in found if f]
            if not ranks:
                break
            best = min(ranks)
            k = found.index(best)
            ids[k : k + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(f[0], i, ids[i], ids[i + 1], f[1]) for i in range(n - 1) if (f := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (f := get((ids[x], ids[y]))):
                    heapq.heappush(heap, (f[0], x, ids[x], ids[y], f[1]))
        return [x for x in ids if x >= 0]


class Memo:
    """ids of pieces of text between white space, in two generations; unknown ones are merged together."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def ids(self, each: list[list[str]]) -> list[list[int]]:
        """The ids of each list of pieces."""
        get = self.young.get
        found = [list(map(get, pieces)) for pieces in each]
        missing = {p for pieces, ids in zip(each, found, strict=True) if None in ids for p, i in zip(pieces, ids, strict=True) if i is None}
        got = self._learn(missing) if missing else {}
        chain = itertools.chain.from_iterable
        return [list(chain(ids if None not in ids else [got[p] if i is None else i for p, i in zip(pieces, ids, strict=True)])) for pieces, ids in zip(each, found, strict=True)]

    def _learn(self, pieces: set[str]) -> dict[str, tuple]:
        old, got, split, long = self.old, {}, {}, []
        for p in pieces:
            if (known := old.get(p)) is not None:
                got[p] = known
            elif len(p) > KEY:
                long.append(p)
            elif p.isalpha():
                split[p] = (p,)
            else:
                split[p] = (p,) if p[0] == " " and p[1:].isalpha() else tuple(_INNER.findall(p))
        get = self.young.get
        parts = {q: get(q) or old.get(q) for qs in split.values() for q in qs}
        new = [q for q, ids in parts.items() if ids is None]
        if new:
            data = [q.encode() for q in new]
            flat, sizes = self.merges.table.merge(self.merges.byte_ids[np.frombuffer(b"".join(data), np.uint8)], np.fromiter(map(len, data), np.int64, len(data)))
            flat, ends = flat.tolist(), np.cumsum(sizes).tolist()
            parts.update((q, tuple(flat[a:b])) for q, a, b in zip(new, [0, *ends], ends))
        for p, qs in split.items():
            got[p] = parts[p] if len(qs) == 1 else tuple(i for q in qs for i in parts[q])
        if len(self.young) + len(got) > MEMO:
            self.old, self.young = self.young, {}
        self.young.update(got)
        for p in long:
            got[p] = tuple(i for q in _INNER.findall(p) for i in self._long(q.encode()))
        return got

    def _long(self, data: bytes) -> list[int]:
        stream = PretokenStream(self.merges)
        return stream.feed(data) + stream.finish()


class PretokenStream:
    """Tokens of one pre-token of any length, out as soon as no later byte can change them."""

    def __init__(self, merges: MergeList):
        self.merges, self.held = merges, b""

    def feed(self, data: bytes) -> list[int]:
        out, at = [], 0
        self.held += data
        window = WINDOW + self.merges.lookahead
        while len(self.held) - at >= window:
            part = self.held[at : at + window]
            end = 0
            for i in self.merges.merge(part):
                end += len(self.merges.bytes[i])
                if end > WINDOW:
                    break
                out.append(i)
                at += len(self.merges.bytes[i])
        self.held = self.held[at:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.merges.merge(self.held), b""
        return out


class StreamEncoder:
    """feed() text in any pieces, finish() at its end; both return what has become certain.

    That is a list of ids (of a pre-token still open, as far as the lookahead settles them,
    or a special token) and of strings: text that begins and ends where pre-tokens do, whose
    ids the memo gives. At most two blocks of text are held.
    """

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.special = re.compile("|".join(map(re.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None
        self.reserve = max([3, *map(len, merges.special)])
        self.buffer, self.inside, self.run = "", None, None

    def feed(self, text: str) -> list[int | str]:
        self.buffer += text
        if len(self.buffer) < BLOCK:
            return []
        out = self._continue(False)
        if self.inside:
            return out
        last = None
        at = len(self.buffer) - 1
        while at > 0 and last is None:
            if _EDGE.match(self.buffer, at):
                last = at
            at -= 1
        if last is not None:
            ready, self.buffer = self.buffer[:last], self.buffer[last:]
            out += self._whole(ready)
        if len(self.buffer) >= 2 * BLOCK:
            out += self._pretokens()
        return out

    def finish(self) -> list[int | str]:
        out = self._continue(True) if self.inside else []
        ready, self.buffer = self.buffer, ""
        return out + self._whole(ready)

    def _whole(self, text: str) -> list[int | str]:
        """Text that begins and ends where pre-tokens do, parted at special tokens."""
        if self.special is None or not self.special.search(text):
            return [text] if text else []
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [text[at : m.start()], self.merges.special[m[0]]]
            at = m.end()
        return out + [text[at:]]

    def _pretokens(self) -> list[int | str]:
        """Without a border in the buffer: its pre-tokens but the last, and the certain tokens of that."""
        text = self.buffer
        edge = len(text) - self.reserve
        if self.special is not None and (m := self.special.search(text)):
            self.buffer = text[m.end() :]
            return [text[: m.start()], self.merges.special[m[0]]]
        out, at = [], 0
        for m in _INNER.finditer(text):
            if m.end() >= edge:
                break
            run = PretokenStream(self.merges)
            out += run.feed(m[0].encode()) + run.finish()
            at = m.end()
        rest = text[at:]
        lead = 1 if rest[:1] == " " and len(rest) > 1 and not _RUN["S"].match(rest[1:2]) else 0
        self.inside = next(k for k, r in _RUN.items() if r.match(rest, lead))
        self.run, self.buffer = PretokenStream(self.merges), rest[lead:]
        return out + self.run.feed(rest[:lead].encode()) + self._continue(False)

    def _continue(self, ended: bool) -> list[int | str]:
        """Carry on within a pre-token that began before the buffer."""
        if not self.inside:
            return []
        m = _RUN[self.inside].match(self.buffer)
        end = m.end() if m else 0
        text, whole = self.buffer, end < len(self.buffer)
        if self.special is not None and (s := self.special.search(text)) and s.start() <= end:
            end, whole = s.start(), True
            closed = True  # a special token ends it as the end of the text does
        else:
            closed = ended
        if not whole and not ended:
            end = max(0, end - self.reserve)
        elif self.inside == "S" and not (closed and (ended and end == len(text) or whole and self.special is not None and self.special.match(text, end))):
            end -= 1  # the last white space before a visible character stands apart
        out = self.run.feed(text[:end].encode())
        self.buffer = text[end:]
        if whole or ended:
            out += self.run.finish()
            self.inside = self.run = None
        return out


def encoded(merges: MergeList, texts: list[str], memo: Memo) -> Iterator[list[list[int]]]:
    """For each step of BLOCK characters, the ids that each text's transducer settles in it.

    All texts go through theirs side by side; what they settle in a step shares one look
    into the memo. One step holds no more than some blocks of each text.
    """
    streams = [StreamEncoder(merges) for _ in texts]
    longest = max(map(len, texts), default=0)
    for at in range(0, longest + 1, BLOCK):
        settled = []
        for t, stream in zip(texts, streams, strict=True):
            out = stream.feed(t[at : at + BLOCK]) if at < len(t) else []
            if at <= len(t) < at + BLOCK:
                out += stream.finish()
            settled.append(out)
        known = iter(memo.ids([_OUTER.findall(x) for out in settled for x in out if isinstance(x, str)]))
        ids: list[list[int]] = []
        for out in settled:
            own: list[int] = []
            for x in out:
                own.extend(next(known)) if isinstance(x, str) else own.append(x)
            ids.append(own)
        yield ids


def encode(merges: MergeList, text: str, memo: Memo | None = None) -> list[int]:
    """ids of a whole text."""
    return [i for (ids,) in encoded(merges, [text], memo or Memo(merges)) for i in ids]


class StreamDecoder:
    """Text of ids, fed in any pieces; bytes of a character not yet whole wait for the rest."""

    def __init__(self, merges: MergeList):
        self.bytes, self.machine = merges.bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        of = self.bytes
        return self.machine.decode(b"".join([of[i] for i in ids]))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


class Digest:
    """Number and digest of ids that come in steps, and the digest of what they decode to."""

    def __init__(self, merges: MergeList, names: list[str], keep: bool):
        self.names, self.kept, self.n = names, [] if keep else None, 0
        self.ids, self.text, self.decoder = hashlib.sha256(), hashlib.sha256(), StreamDecoder(merges)

    def feed(self, ids: list[int]) -> None:
        if not ids:
            return
        names = self.names
        self.ids.update(((b"," if self.n else b"") + ",".join([names[i] for i in ids]).encode()))
        self.text.update(self.decoder.feed(ids).encode())
        self.n += len(ids)
        if self.kept is not None:
            self.kept += ids

    def row(self) -> dict:
        self.text.update(self.decoder.finish().encode())
        out = {"n_tokens": self.n, "ids_sha256": self.ids.hexdigest(), "decoded_sha256": self.text.hexdigest()}
        return out if self.kept is None else out | {"ids": self.kept}


@functools.lru_cache(maxsize=2)
def load(name: str) -> MergeList:
    return MergeList(public_tokenizers.path(name))


@functools.lru_cache(maxsize=2)
def memo_of(name: str) -> Memo:
    """One memo for each Python worker, so that it outlives a task."""
    return Memo(load(name))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) for each row; null counts as empty, which has no ids.

    Texts of any length pass in bounded memory but for the text itself; repeated rows stay,
    an empty table gives no rows, other columns play no part.
    """

    def make():
        merges, memo = load(vocabulary), memo_of(vocabulary)
        names = [str(i) for i in range(len(merges.bytes))]

        def each(texts: list[str]) -> list[dict]:
            made = [Digest(merges, names, keep_ids) for _ in texts]
            for step in encoded(merges, texts, memo):
                for d, ids in zip(made, step, strict=True):
                    d.feed(ids)
            return [d.row() for d in made]

        return each

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return text_pass(docs, make, fields, text_col, [id_col], binary=False, keeps=memo_of)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of documents."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
