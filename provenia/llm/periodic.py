"""Runs of words that repeat with a short period, found with a suffix automaton of each text.

A run is a stretch of consecutive words with smallest period q that no neighbouring word
extends keeping that period. In a suffix automaton two prefixes of the words meet at the
state of their longest common suffix. States are taken from the longest to the shortest
and the sets of their end positions, kept in order, are merged small into large: where two
positions become neighbours at a state, d apart, and the state's length is d or more, the
words between them form a square of smallest period d. The state's length also says where
that square's run begins, as the words before it differ, and the last such pair says where
it ends, so each seed is extended to its whole run.

Only stretches of words that can hold a run go to an automaton: in a run of four periods
each three words stand again one period on or back, so words whose three-word gram has no
other near by are outside any run. That test is exact and leaves out most prose.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import SLICE_ROWS, table, turn_to

#: Least number of periods and of words of a run; words of the grams that are sought again.
TIMES, LEAST, GRAM = 4, 6, 3
#: Positions up to which small sets are put into large ones one by one rather than by sorting.
FEW = 16
OUT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, link, end) of each state of the words' suffix automaton; end is the position that made it, or -1."""
    length, link, end, step = [0], [-1], [-1], [{}]
    last = 0
    for i, w in enumerate(words):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        end.append(i)
        step.append({})
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                step.append(step[q].copy())
                while p >= 0 and step[p].get(w) == q:
                    step[p][w] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return length, link, end


def _neighbours(large: list[int], small: list[int]) -> Iterator[tuple[int, int]]:
    """Pairs, one of either list, that are next to each other in the union of two ordered lists."""
    before = None  # where the last one of small would stand in large
    for k, x in enumerate(small):
        at = bisect_left(large, x)
        if at and at != before:
            yield large[at - 1], x
        if at < len(large) and (k + 1 == len(small) or small[k + 1] > large[at]):
            yield x, large[at]
        before = at


def automaton_runs(words: list[int], times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of at least `times` (2 or more) periods and `least` words, in order."""
    length, link, end = automaton(words)
    low = max(times - 1, least // 2)  # a pair d apart needs (times - 1) * d and least - d common words
    sets: list[list[int] | None] = [[e] if e >= 0 else None for e in end]
    seeds: dict[int, list[tuple[int, int]]] = {}
    found: dict[tuple[int, int], int] = {}
    by_length = np.argsort(-np.array(length), kind="stable").tolist()
    for v in by_length:
        n, own = length[v], sets[v]
        if n < low:
            break
        for x, y in seeds.pop(v, ()):
            if own[bisect_left(own, x) + 1] == y:  # no child that came later has put one between them
                key = (x - n + 1, y - x)
                found[key] = max(found.get(key, 0), y)
        p = link[v]
        if length[p] < low:
            sets[v] = None
            continue
        large, small = sets[p], own
        if large is not None:
            if len(large) < len(small):
                large, small = small, large
            most = length[p]
            near = [(x, y) for x, y in _neighbours(large, small) if (times - 1) * (y - x) <= most and most + y - x >= least]
            if near:
                seeds.setdefault(p, []).extend(near)
            if len(small) <= FEW:
                for x in small:
                    insort(large, x)
            else:
                large.extend(small)
                large.sort()
            sets[p] = large
        else:
            sets[p] = own
        sets[v] = None
    return sorted((s, e - s + 1, q) for (s, q), e in found.items())


def stretches(words: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int]]:
    """(from, to) of the stretches that hold all runs: each gram in them has an equal one a `times`-th of their length away at most."""
    gram = GRAM if times >= 3 and least >= 4 else 1
    n = len(words) - gram + 1
    if len(words) < max(least, times):
        return []
    key, top = words[:n].astype(np.int64), int(words.max()) + 1
    for k in range(1, gram):
        if top >= 1 << 31:
            _, key = np.unique(key, return_inverse=True)
            top = int(key.max()) + 1
        key = key * (int(words.max()) + 1) + words[k : n + k]
        top *= int(words.max()) + 1
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    gap, apart = np.full(n, len(words) + 1), (order[1:] - order[:-1])[same]
    left, right = order[:-1][same], order[1:][same]
    gap[left] = apart
    gap[right] = np.minimum(gap[right], apart)
    at = np.flatnonzero(gap * times <= len(words))
    while len(at):
        edge = np.flatnonzero(np.diff(at) > 1)
        first, last = np.r_[0, edge + 1], np.r_[edge, len(at) - 1]
        size = at[last] - at[first] + gram
        room = np.repeat(np.where(size >= least, size, 0), last - first + 1)
        keep = gap[at] * times <= room
        if keep.all():
            return list(zip(at[first].tolist(), (at[last] + gram).tolist(), strict=True))
        at = at[keep]
    return []


def word_runs(words: list[bytes], times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of a list of words, by start and then period."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    out = []
    for a, b in stretches(ids, times, least):
        out += [(a + s, n, q) for s, n, q in automaton_runs(ids[a:b].tolist(), times, least)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        depth[s + q] += 1
        depth[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def _report(words: list[bytes], times: int, least: int) -> dict:
    runs = word_runs(words, times, least)
    s, n, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return {
        "n_runs": len(runs), "start": s, "length": n, "period": q, "exponent_milli": 1000 * n // q if runs else None,
        "runs_sha256": sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), "collapsed_sha256": sha(b" ".join(collapsed(words, runs))),
    }


def planted(words: list[bytes], h: int | None) -> list[bytes]:
    """The words that a number h makes periodic from some place on, if it is divisible by ten; else the words."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, least: int = LEAST,
    rewrite: Callable[[list[bytes], int | None], list[bytes]] | None = None, by: Column | None = None,
) -> DataFrame:
    """A row for each row of docs: its id, OUT's number of runs, the most repetitive run, and digests of all runs and of the text without repeats.

    Words are parted by ASCII white space. A null or empty text has no words: no runs, four
    nulls, digests of nothing. Texts are read whole; memory follows the longest stretch of one
    text that may repeat itself, some hundred bytes a word. Ids may be null; repeated rows
    give repeated rows, an empty table none; other columns play no part. Of runs of equal
    length to period the first stands, then that of the smaller period. rewrite(words, value
    of `by`) may change the words before they are searched.
    """
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"), (F.lit(None).cast("long") if by is None else by).alias("by"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(None)
        kinds = {"long": pa.int64(), "string": pa.string()}
        fields = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in OUT.split(", ")])
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                got = []
                for text, h in zip(part.column(1), part.column(2), strict=True):
                    words = text.as_py().split()
                    got.append(_report(words if rewrite is None else rewrite(words, h.as_py()), times, least))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([x[f.name] for x in got], f.type) for f in fields)], names=["id", *fields.names])

    out = source.mapInArrow(run, f"id {kind.simpleString()}, {OUT}")
    return out.select(F.col("id").alias(id_col), *[f.split()[0] for f in OUT.split(", ")])


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every text of documents, of which those whose id's CRC-32 ends in 0 are made periodic first."""
    return periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted, by=F.crc32(F.col("doc_id").cast("string").cast("binary")))
