"""Toxic documents: a lexicon matched through Levenshtein automata, weighed by context.

The lexicon is learned from labelled documents: words, and stems of inflected words, that
toxic documents have and clean ones hardly ever. It is a trie; the Levenshtein automaton
of all its terms is the trie walked with a budget of edits, made deterministic as words
are read, so a word costs its letters up to where no term is within reach. A hit counts
by the precision of its term and by the words around it: marks of quotation and of
reporting lower it, marks of address raise it. A logistic regression on these sums,
fitted on documents that had no part in their lexicon, gives the score.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import cut, table, text_pass
from provenia.llm.learning import Logistic, labelled_sample, remainder

#: Labelled documents of each class to learn from.
SAMPLE = 4000
#: Letters of a stem; documents and share of toxic ones with a term; share of clean ones; ratio of the two.
STEM, LEAST_DOCS, LEAST_SHARE, MOST_CLEAN, RATIO = (4, 12), 3, 0.004, 0.002, 20.0
#: Letters from which one and two edits are allowed.
EDITS = ((5, 1), (10, 2))
#: Words on either side that make the context; entries of the memo of words; states of the automaton.
CONTEXT, MEMO, STATES = 6, 200_000, 20_000
#: Words that a quotation has at most between its marks.
SAID = 60
#: Files of the labelled sample.
FILES = 8
#: Share of hold-outs and score from which a document is toxic.
FOLD, TOXIC = (3, 1), 0.7
#: Terms to begin with where labels teach none.
SEED = ("idiot", "moron", "scum", "worthless", "pathetic", "disgusting", "stupid", "imbecile")
#: Signs of quotation or reporting, and of address.
QUOTING = frozenset("said says quoted quote called wrote writes word term phrase alleged reported comment sagte schrieb zitat wort dijo escribió cita palabra dit écrit citation mot".split())
ADDRESSING = frozenset("you your you're youre yourself u du dich dein ihr euch tú tu te vosotros usted vous toi votre".split())
#: Marks that open a quotation, with those that close it; the first three do wherever they stand.
_CLOSERS = {"“": "”“", "„": "“”", "«": "»", "»": "«", "‘": "’", '"': '"', "'": "'", "`": "`'"}
_PARTS = re.compile(r"[^\W_]+|[\"'“”„«»‘’`]")
_LETTERS = re.compile(r"[^\W_]+")


class Term(NamedTuple):
    text: str
    stem: bool
    weight: float


class Automaton:
    """The terms within reach of a word: lexicon trie and edit budget, made deterministic on demand."""

    def __init__(self, terms: list[Term]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[Term]] = [[]]
        self.budget = [0]
        for t in terms:
            node, k = 0, self.edits(t)
            self.budget[0] = max(self.budget[0], k)
            for c in t.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], k)
            self.ends[node].append(t)
        self._reset()

    @staticmethod
    def edits(t: Term) -> int:
        return max([k for n, k in EDITS if len(t.text) >= n + t.stem], default=0)

    def _reset(self) -> None:
        # A state is the packed, sorted array of (node << 2 | edits) that its letters can have reached.
        self.states: dict[bytes, int] = {b"": 0}
        self.sets: list[bytes] = [b""]
        self.next: list[dict[str, int]] = [{}]
        self.word_end: list = [None]
        self.stem_end: list = [None]
        self.start = self._state({0: 0})

    def _state(self, reach: dict[int, int]) -> int:
        todo = list(reach)
        while todo:  # letters of the term that the word leaves out
            node = todo.pop()
            e = reach[node] + 1
            for child in self.children[node].values():
                if e <= self.budget[child] and e < reach.get(child, 99):
                    reach[child] = e
                    todo.append(child)
        key = array("I", sorted(node << 2 | e for node, e in reach.items())).tobytes()
        if key not in self.states:
            hits = [(e, -t.weight, t) for node, e in reach.items() for t in self.ends[node] if e <= self.edits(t)]
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            self.word_end.append(min(hits, default=None))
            self.stem_end.append(min((h for h in hits if h[2].stem), default=None))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        reach: dict[int, int] = {}
        for packed in memoryview(self.sets[state]).cast("I"):
            node, e = packed >> 2, packed & 3
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.budget[child] and cost < reach.get(child, 99):
                    reach[child] = cost
            if e + 1 <= self.budget[node] and e + 1 < reach.get(node, 99):
                reach[node] = e + 1
        to = self._state(reach)
        self.next[state][c] = to
        return to

    def find(self, word: str) -> tuple | None:
        """(edits, term) of the nearest term, that of greatest weight first; None if none is near."""
        if len(self.sets) > STATES:
            self._reset()
        state, best = self.start, None
        for c in word:
            to = self.next[state].get(c)
            state = self._step(state, c) if to is None else to
            if not state:
                break
            stem = self.stem_end[state]
            if stem and (best is None or stem < best):
                best = stem
        else:
            end = self.word_end[state]
            if end and (best is None or end < best):
                best = end
        return best and (best[0], best[2])


class _Words(dict):
    """What each piece of a text, as split at white space, is to the lexicon: its number of words, and its hits as (word, weight, edits)."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, piece: str):
        if len(self) >= MEMO:
            self.clear()
        parts = _LETTERS.findall(piece.lower())
        found = [(k, self.automaton.find(part)) for k, part in enumerate(parts)]
        out = (len(parts), tuple((k, hit[1].weight, hit[0]) for k, hit in found if hit))
        if len(piece) <= 40:
            self[piece] = out
        return out


def spoken(text: str) -> tuple[list[str], list[bool]]:
    """The words of a text (runs of letters and digits, lower case), and whether each is within a quotation.

    A quotation goes from a mark that opens to the next that closes that kind, SAID words
    on at most. Straight marks and apostrophes open before a word and not within one.
    """
    words: list[str] = []
    spans, opened = [], None
    for piece in text.lower().split():
        for m in _PARTS.finditer(piece):
            c = m.group()
            if c not in _CLOSERS and c not in "”’":
                words.append(c)
                continue
            before, after = piece[m.start() - 1 : m.start()].isalnum(), piece[m.end() : m.end() + 1].isalnum()
            if opened and c in _CLOSERS[opened[0]] and not (c in "'’`" and before and after):
                if len(words) - opened[1] <= SAID:
                    spans.append((opened[1], len(words)))
                opened = None
            elif c in "“„«" or c in _CLOSERS and after and not before:
                if opened is None or len(words) - opened[1] > SAID or c in "“„«":
                    opened = (c, len(words))
    within = [False] * len(words)
    for a, b in spans:
        within[a:b] = [True] * (b - a)
    return words, within


def measure(words: _Words, text: str) -> list[float]:
    """Sums over a text's hits: exact and near ones as abuse, all as quotation, and their share of the words.

    A hit counts less within a quotation, and the less the more words of reporting are near;
    it counts more beside words of address, of which a quotation's own are no address of
    the reader and do not count for what is outside, nor those outside for it.
    """
    found, n = [], 0
    for piece in text.split():
        size, hits = words[piece]
        found += [(n + k, weight, edits) for k, weight, edits in hits]
        n += size
    exact = near = quoted = 0.0
    said, within = spoken(text) if found else ([], [])
    for k, weight, edits in found:
        around = range(max(0, k - CONTEXT), min(n, k + CONTEXT + 1))
        report = within[k] + sum(said[j] in QUOTING for j in around)
        address = 1 + (0 if within[k] else sum(said[j] in ADDRESSING and not within[j] for j in around))
        share = address / (address + 2 * report)
        if edits:
            near += weight * share
        else:
            exact += weight * share
        quoted += weight * (1 - share)
    return [float(np.log1p(exact)), float(np.log1p(near)), float(np.log1p(quoted)), (exact + near) / max(1, n) ** 0.5]


def _terms_of(text: str) -> set[tuple[str, bool]]:
    out = set()
    for w in set(_LETTERS.findall(text.lower())):
        if len(w) >= STEM[0]:
            out.add((w, False))
            out.update((w[:n], True) for n in range(STEM[0], min(len(w), STEM[1] + 1)))
    return out


def _counts(sample: DataFrame) -> DataFrame:
    """(part, term, stem, docs): documents of each half of the sample that have a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n.update((part, *t) for t in _terms_of(text))
            if len(n) > 300_000:
                yield flush(n)
                n.clear()
        if n:
            yield flush(n)

    def flush(n: Counter) -> pa.RecordBatch:
        part, term, stem = zip(*n, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(term), pa.array(stem), pa.array(list(n.values()), pa.int64())], names=["part", "term", "stem", "docs"])

    return sample.select("part", "text").mapInArrow(run, "part int, term string, stem boolean, docs long").groupBy("part", "term", "stem").agg(F.sum("docs").alias("docs"))


def choose_terms(toxic: dict, clean: dict, n_toxic: int, n_clean: int) -> list[Term]:
    """Terms of a lexicon from the documents of each class that have (term, is a stem)."""
    least = max(LEAST_DOCS, LEAST_SHARE * n_toxic)
    good = {}
    for key, docs in toxic.items():
        share, other = docs / max(1, n_toxic), clean.get(key, 0) / max(1, n_clean)
        if docs >= least and other <= MOST_CLEAN and share >= RATIO * (other + 0.5 / max(1, n_clean)):
            good[key] = docs / n_toxic / (share + other + 0.5 / max(1, n_clean))
    by_prefix: dict[str, list] = {}
    for key in good:
        for n in range(STEM[0], len(key[0]) + 1):
            by_prefix.setdefault(key[0][:n], []).append(key)
    out: dict[tuple[str, bool], Term] = {}
    for key in sorted(good, key=lambda k: (len(k[0]), k)):
        word, stem = key
        if any((word[:n], True) in out for n in range(STEM[0], len(word) + (not stem))):
            continue
        if stem:  # the longest term that nearly all documents with the stem have
            same = [k for k in by_prefix[word] if toxic[k] >= 0.95 * toxic[key]]
            word, stem = max(same, key=lambda k: (len(k[0]), not k[1]))
        out[(word, stem)] = Term(word, stem, round(good[(word, stem)], 6))
    return sorted(out.values(), key=lambda t: (-toxic[(t.text, t.stem)], t))


def _candidates(sample: DataFrame, n_toxic: list[int], n_clean: list[int]) -> tuple[list[dict], list[dict]]:
    """Documents of each class, by half of the sample, that have a term; only of terms good enough in a half or in both."""
    by_part = [F.sum(F.when(F.col("part") == p, F.col("docs")).otherwise(0)) for p in (0, 1)]
    of = {c: _counts(sample.where(F.col("label") == k)).groupBy("term", "stem").agg(*[n.alias(f"{c}{p}") for p, n in enumerate(by_part)]) for k, c in ((1, "toxic"), (0, "clean"))}
    rows = of["toxic"].where(F.col("toxic0") + F.col("toxic1") >= LEAST_DOCS).join(of["clean"], ["term", "stem"], "left").na.fill(0)

    def good(docs: Column, other_docs: Column, toxic: int, clean: int) -> Column:
        share, other = docs / max(1, toxic), other_docs / max(1, clean)
        return (docs >= max(LEAST_DOCS, LEAST_SHARE * toxic)) & (other <= MOST_CLEAN) & (share >= RATIO * (other + 0.5 / max(1, clean)))

    t, c = ([F.col(f"{x}{p}") for p in (0, 1)] for x in ("toxic", "clean"))
    either = good(t[0], c[0], n_toxic[0], n_clean[0]) | good(t[1], c[1], n_toxic[1], n_clean[1]) | good(t[0] + t[1], c[0] + c[1], sum(n_toxic), sum(n_clean))
    toxic, clean = [{}, {}], [{}, {}]
    for r in rows.where(either).collect():
        for p in (0, 1):
            toxic[p][(r.term, r.stem)], clean[p][(r.term, r.stem)] = r[f"toxic{p}"], r[f"clean{p}"]
    return toxic, clean


class Model(NamedTuple):
    terms: list
    score: Logistic


def _nearly_once(sample: DataFrame) -> DataFrame:
    """One document of each group of near copies, that of the smallest id: those with the same smallest shingle of three words."""

    def make():
        def one(text: str) -> dict:
            w = text.encode().split()
            return {"least": min((xxhash.xxh64_intdigest(b" ".join(w[i : i + 3])) >> 1 for i in range(max(1, len(w) - 2))), default=0)}

        return lambda texts: [one(t) for t in texts]

    marked = text_pass(sample, make, "least long", "text", binary=False)
    return marked.groupBy("label", "least").agg(F.min(F.struct("id", "text")).alias("first")).select("label", "first.id", "first.text")


def fit(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = FOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The lexicon and the score, from at most SAMPLE labelled documents of each class outside the fold.

    Without toxic or without clean labelled documents the seed terms and fixed weights stand.
    """
    picked = labelled_sample(docs, labels, label_col, fold, SAMPLE, id_col, text_col)
    sample = cut(_nearly_once(picked).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int")).coalesce(FILES))
    n = {(r.label, r.part): r.n for r in sample.groupBy("label", "part").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = ([n.get((k, p), 0) for p in (0, 1)] for k in (1, 0))
    seed = [Term(t, False, 0.9) for t in SEED]
    if not sum(n_toxic) or not sum(n_clean):
        x = np.array([[0, 0, 0, 0], [0.6, 0, 0, 0.05], [1.1, 0, 0, 0.1], [1.4, 0.6, 0, 0.3]])
        return Model(seed, Logistic(x, np.array([0, 0, 1, 1]), 0.1))
    toxic, clean = _candidates(sample, n_toxic, n_clean)
    both = [{k: d[0].get(k, 0) + d[1].get(k, 0) for k in {*d[0], *d[1]}} for d in (toxic, clean)]
    halves = [choose_terms(toxic[p], clean[p], n_toxic[p], n_clean[p]) or seed for p in (0, 1)]
    terms = choose_terms(*both, sum(n_toxic), sum(n_clean)) or seed

    def make():
        words = [_Words(Automaton(t)) for t in halves]
        return lambda texts: [{"x0": measure(words[0], t), "x1": measure(words[1], t)} for t in texts]

    rows = text_pass(sample, make, "x0 array<double>, x1 array<double>", "text", ["label", "part"], binary=False)
    rows = rows.select("label", F.when(F.col("part") == 0, F.col("x1")).otherwise(F.col("x0")).alias("x")).collect()
    return Model(terms, Logistic(np.array([r.x for r in rows]), np.array([r.label for r in rows])))


def _scorer(model: Model):
    terms, score = list(model.terms), model.score

    def make():
        words = _Words(Automaton(terms))
        return lambda texts: [{"score": float(p)} for p in score([measure(words, t) for t in texts])]

    return make


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row; null and empty texts get the score of no hits, repeated rows stay.

    Texts of any length are read whole, in time linear in it; an empty table gives no rows, other columns play no part.
    """
    return text_pass(docs, _scorer(model), "score double", text_col, [id_col], binary=False)


def clean(docs: DataFrame, model: Model, text_col: str = "text", least: float = TOXIC) -> DataFrame:
    """The rows of docs, all columns, whose score is below `least`.

    Null and empty texts have no hits and stay, equal texts stay or go together, texts of
    any length are read whole, an empty table stays empty.
    """
    scorer = _scorer(model)

    def make():
        f = scorer()
        return lambda texts: [None if x["score"] >= least else {"stays": True} for x in f(texts)]

    return text_pass(docs, make, "stays boolean", text_col, binary=False, shown=False)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(remainder("doc_id", FOLD[0]) == FOLD[1], F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted"))
