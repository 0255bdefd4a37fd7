"""Many words or quotes sought at once: one automaton, one pass over each text.

An Aho-Corasick automaton holds all that is sought, folded as the pattern search of
``find_quote`` folds: each character by itself to its lower case, and for quotes each run
of white space to one space. A text is folded likewise, with a map back to its own
offsets, and read once, however many words there are. Positions are code points.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of quotes that one automaton may hold; beyond it quotes are looked up by their words.
HELD = 500_000
#: Code points that are white space in Unicode.
_WHITE = np.zeros(0x3002, bool)
_WHITE[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
PLACES = "map<string,array<struct<s:int,e:int>>>"
HEADERS = "array<struct<s:int,e:int>>"


@functools.lru_cache(maxsize=10_000)
def _fold_one(c: str) -> str:
    """The lower case of a character's upper case where each is one character, as Java compares characters in any case."""
    up = c.upper() if len(c.upper()) == 1 else c
    if up == "İ":
        return "i"
    return up.lower() if len(up.lower()) == 1 else up


def fold(text: str) -> str:
    """text in one case, character by character: positions stay."""
    if text.isascii():
        return text.lower()
    up = text.upper()
    low = up.lower() if len(up) == len(text) else ""
    if len(low) != len(text):
        return "".join(map(_fold_one, text))
    return low.replace("ς", "σ")  # at a word's end only


def fold_blanks(text: str) -> tuple[str, np.ndarray]:
    """(folded, at): fold() with each run of white space as one space, and the offset in text of each of its characters."""
    code = np.frombuffer(fold(text).encode("utf-32-le"), "<u4")
    white = _WHITE[np.minimum(code, len(_WHITE) - 1)]
    at = np.flatnonzero(~(white & np.r_[False, white[:-1]]))
    return np.where(white, 32, code)[at].astype("<u4").tobytes().decode("utf-32-le"), at


def folded_quote(quote: str) -> str:
    """What is sought for a quote: folded, single spaces between words, none at the ends; "" for one without words."""
    return fold_blanks(quote)[0].strip(" ")


def automaton(words: dict[str, object]) -> ahocorasick.Automaton | None:
    """The automaton of folded words with what each stands for; None without words."""
    found = ahocorasick.Automaton()
    for word, what in words.items():
        if word:
            found.add_word(word, (len(word), what))
    if not len(found):
        return None
    found.make_automaton()
    return found


def first_places(text: str, sought: ahocorasick.Automaton, quotes: list[str]) -> Iterator[tuple[int, int]]:
    """(number of a quote, where it begins) for each quote that text has, as find_quote() places it.

    What the automaton finds stands for a list of numbers of quotes. A quote that stands as
    it is begins there, even if it is in another case or spacing before.
    """
    folded, at = fold_blanks(text)
    first: dict[int, int] = {}
    for end, (n, numbers) in sought.iter(folded):
        for k in numbers:
            if k not in first:
                first[k] = int(at[end - n + 1])
    for k, loose in first.items():
        exact = text.find(quotes[k])
        yield k, exact if exact >= 0 else loose


def all_places(text: str, sought: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Every place (start, end) of each word, in order, overlapping ones too; the words are folded, blanks count as they are."""
    out: dict[str, list[tuple[int, int]]] = {}
    for end, (n, word) in sought.iter(fold(text)):
        out.setdefault(word, []).append((end - n + 1, end + 1))
    return out


def chain(places: list[list[tuple[int, int]]], gap: int) -> list[tuple[int, int]]:
    """(start, end) of each place of the first list from which all lists can be followed in order.

    The next place is the first that begins where the last one ends or later, and it must do
    so within `gap`. Each pair of lists is merged once from the back, so the time is linear
    in the places.
    """
    if not places or not all(places):
        return []
    reach: list[int | None] = [e for _, e in places[-1]]
    for before, after in zip(places[-2::-1], places[:0:-1], strict=True):
        now, k = [], 0
        for _, e in before:
            while k < len(after) and after[k][0] < e:
                k += 1
            now.append(reach[k] if k < len(after) and after[k][0] - e <= gap else None)
        reach = now
    return [(s, end) for (s, _), end in zip(places[0], reach, strict=True) if end is not None]


def with_places(docs: DataFrame, words: list[str], gap: int, siblings: str | None = None, text: str = "text") -> DataFrame:
    """docs with `places`, where each of the words stands, and `headers`, where all siblings follow each other.

    One pass reads a text once for all words and for the siblings of its own row, a column
    of lists of words; fewer than two siblings have no headers. places is a map from the
    words to (s, e), in any case, which has no entry for a word that is nowhere. A null text has neither.
    The words are few, a vocabulary; they go to the tasks with the code.
    """
    names = docs.columns
    known: dict[str, list[str]] = {}
    for w in sorted(set(filter(None, words))):
        known.setdefault(fold(w), []).append(w)
    kin = F.array().cast("array<string>") if siblings is None else F.coalesce(F.col(siblings), F.array().cast("array<string>"))
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text).alias("text"), kin.alias("kin"))
    place = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    spans = lambda found: [{"s": s, "e": e} for s, e in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought, own, last = automaton({w: w for w in known}), None, None
        for batch in batches:
            places, headers = [], []
            for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                places.append([(w, spans(found)) for folded, found in all_places(t, sought).items() for w in known[folded]] if t and sought else [])
                line = [fold(w) for w in k if w]
                if not t or len(line) < 2 or len(line) < len(k):
                    headers.append([])
                    continue
                if line != last:
                    own, last = automaton({w: w for w in line}), line
                found = all_places(t, own)
                headers.append(spans(chain([found.get(w, []) for w in line], gap)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.map_(pa.string(), place)), pa.array(headers, place)], names=["row", "places", "headers"])

    schema = source.select("row", F.lit(None).cast(PLACES).alias("places"), F.lit(None).cast(HEADERS).alias("headers")).schema
    return source.mapInArrow(run, schema).select(*[F.col(f"row.`{c}`") for c in names], "places", "headers")


def apart(places: Column) -> Column:
    """Of places in order those that do not overlap one before them that is kept."""
    step = lambda acc, p: F.when(p["s"] >= F.coalesce(F.try_element_at(acc, F.lit(-1))["e"], F.lit(0)), F.array_append(acc, p)).otherwise(acc)
    return F.when(F.size(places) < 2, places).otherwise(F.aggregate(places, F.array().cast(HEADERS), step))


def quotes_by_automaton(quotes: list[tuple[object, str]], docs: DataFrame, with_text: bool) -> DataFrame:
    """(number, doc_id, start[, text]) of each quote, by its number in the list, in each document that has it: one pass, no shuffle."""
    said = [q for _, q in quotes]
    numbers: dict[str, list[int]] = {}
    for k, q in enumerate(said):
        numbers.setdefault(folded_quote(q), []).append(k)
    kept = ["doc_id", "text"] if with_text else ["doc_id"]
    source = docs.where(F.col("text").isNotNull()).select(F.struct(*kept).alias("row"), F.col("text").alias("text"))
    found = pa.list_(pa.struct([("number", pa.int32()), ("start", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = automaton(numbers)
        for batch in batches:
            hits = [[{"number": k, "start": s} for k, s in first_places(t, sought, said)] if sought else [] for t in batch.column(1).to_pylist()]
            has = pa.array([bool(h) for h in hits])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(has), pa.array([h for h in hits if h], found)], names=["row", "hits"])

    schema = source.select("row", F.lit(None).cast("array<struct<number:int,start:int>>").alias("hits")).schema
    return source.mapInArrow(run, schema).select("row.*", F.explode("hits").alias("h")).select("h.number", "doc_id", "h.start", *kept[1:])
