"""Quality rules learned as a decision list and applied as Spark conditional expressions.

Statistics of whole texts are numbers; labelled rows teach, by sequential covering, rules
that mark poor documents: a rule grows by the threshold condition of greatest FOIL gain
on two thirds of the rows and is pruned on the rest; the rows it covers are then set
aside and the next rule is learned. The ordered rules become one WHEN ... OTHERWISE.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import table, text_pass
from provenia.llm.learning import labelled_sample

#: Labelled rows of each class to learn from; rows with this remainder are never learned from, so that rules can be judged on them.
SAMPLE, FOLD = 8000, (5, 0)
#: Base rule: fewer words fail, and so do texts of which more than this percentage of words repeats.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Rules at most, conditions of a rule at most, precision a rule needs, rows it must cover, thresholds tried.
RULES, CONDITIONS, PRECISION, COVER, CUTS = 12, 4, 0.7, 5, 48
#: Bytes of a text split into words at a time.
BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SYMBOLS, _UPPER, _DIGITS, _MARKS = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58)), b"!?;:,."
_WHITE = b" \t\n\r\x0b\x0c"
_CONTINUES = bytes(range(128, 192))
#: What rules may test, as shares of words or characters.
FEATURES = ("symbols_per_word", "dup_line_share", "repeat_share", "chars_per_word", "upper_share", "digit_share", "mark_share", "words_per_line")
STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_digits long, n_marks long"


def _words(data: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(data):
        gap = _SPACE.search(data, at + BLOCK) if len(data) - at > BLOCK else None
        end = gap.start() if gap else len(data)
        yield data[at:end].split()
        at = end


def statistics(data: bytes) -> dict:
    """The counts of a UTF-8 text; words are runs of anything but ASCII white space."""
    known: dict[bytes, int] = {}
    parts = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64) for words in _words(data)]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    n = len(ids)
    repeated = 0
    if n >= 4:
        pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
        _, where, times = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
        again = times[where] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        repeated = int(covered.sum())
    seen: set[bytes] = set()
    lines = duplicates = 0
    for line in data.split(b"\n"):
        if line and line.strip():
            lines += 1
            duplicates += line in seen
            seen.add(line)
    count = lambda these: len(data) - len(data.translate(None, these))
    return {
        "n_words": n,
        "word_chars": len(data) - count(_WHITE) - count(_CONTINUES),
        "n_symbols": count(_SYMBOLS),
        "n_dup_lines": duplicates,
        "n_repeat_words": repeated,
        "n_lines": lines,
        "n_upper": count(_UPPER),
        "n_digits": count(_DIGITS),
        "n_marks": count(_MARKS),
    }


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (by default the id) and STATISTICS for each row; null texts count as empty."""
    return text_pass(docs, lambda: lambda texts: [statistics(t) for t in texts], STATISTICS, text_col, carry or [id_col])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def features() -> list[Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    of = [F.col("n_symbols") / words, F.col("n_dup_lines") / lines, F.col("n_repeat_words") / words, F.col("word_chars") / words, F.col("n_upper") / chars, F.col("n_digits") / chars, F.col("n_marks") / chars, F.col("n_words") / lines]
    return [c.alias(name) for c, name in zip(of, FEATURES, strict=True)]


class Condition(NamedTuple):
    feature: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.threshold if self.above else x[:, self.feature] <= self.threshold

    def column(self) -> Column:
        value = F.col(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold


Rule = list[Condition]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, y: np.ndarray) -> Rule:
    rule: Rule = []
    inside = np.ones(len(x), bool)
    while len(rule) < CONDITIONS:
        p, n = y[inside].sum(), (~y[inside]).sum()
        if not n:
            break
        best, gain = None, 1e-9
        for f in range(x.shape[1]):
            values = np.unique(x[inside, f])
            if len(values) < 2:
                continue
            places = np.unique(np.linspace(0, len(values) - 2, CUTS).astype(int))
            for t in (values[places] + values[places + 1]) / 2:
                for above in (True, False):
                    c = Condition(f, above, float(t))
                    now = inside & c.holds(x)
                    q, m = y[now].sum(), (~y[now]).sum()
                    if q and (g := q * (np.log2(q / (q + m)) - np.log2(p / (p + n)))) > gain:
                        best, gain = c, g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        inside = covers(r, x)
        p, n = y[inside].sum(), (~y[inside]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=rule)


def learn(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """Rules in the order to try them; each marks poor rows. None if a class is missing."""
    x, bad = np.asarray(x, float), np.asarray(bad, bool)
    rules: list[Rule] = []
    part = np.arange(len(x)) % 3
    while len(rules) < RULES and bad.any() and not bad.all():
        grow = part < 2
        rule = _prune(_grow(x[grow], bad[grow]), x[~grow], bad[~grow])
        inside = covers(rule, x)
        if not rule or bad[inside].sum() < COVER or bad[inside].mean() < PRECISION:
            break
        rules.append(rule)
        x, bad, part = x[~inside], bad[~inside], part[~inside]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where no rule marks the row; the columns named in FEATURES must be there."""
    chain = None
    for rule in rules:
        all_of = rule[0].column()
        for c in rule[1:]:
            all_of = all_of & c.column()
        chain = F.when(all_of, False) if chain is None else chain.when(all_of, False)
    return F.lit(True) if chain is None else chain.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """Rules from at most SAMPLE labelled rows of each class (label 0: poor) that pass the base rule."""
    sample = measured(labelled_sample(docs, labels, label_col, FOLD, SAMPLE, id_col, text_col), carry=["id", "label"])
    rows = sample.where(~base_failed()).orderBy(F.xxhash64("id"), "id").select("label", *features()).collect()
    if not rows:
        return []
    return learn(np.array([r[1:] for r in rows]), np.array([r[0] == 0 for r in rows]))


def judged(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row.

    kept is false where the base rule fails or a learned rule marks the row. A null or
    empty text has no words and fails. Texts of any length are counted whole. Repeated rows
    stay and are judged alike; an empty table gives no rows, other columns play no part.
    """
    rows = measured(docs, id_col, text_col).select(F.col(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), *features())
    return rows.select(F.col(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """doc_id, the counts of the base rule, base_failed and kept for each row of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, fit(docs, table(spark, sf_dir, "labels")))
