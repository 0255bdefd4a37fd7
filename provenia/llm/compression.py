"""Quality scores from compression: which class's dictionary compresses a text better.

A Zstandard dictionary is trained on labelled good text and one on bad text. Every block
of a text is compressed with each; the difference of the total sizes over the text's size
says which class the text resembles. Text that repeats itself compresses alike with
either, so the size without a dictionary, over the text's own, stands beside it. Both are
sizes by compression; nothing else about a text is looked at. A logistic regression on
them, fitted on other labelled documents than the dictionaries, gives the probability.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import cut, table, text_pass
from provenia.llm.learning import Logistic, labelled_sample, remainder

#: Labelled documents of each class to learn from; blocks of each class for its dictionary; its bytes.
SAMPLE, BLOCKS, DICTIONARY = 4000, 1500, 64 << 10
#: Bytes of a block; level of compression; parameters of dictionary training.
BLOCK, LEVEL, COVER_K, COVER_D = 4096, 3, 64, 8
#: Rows with this remainder are never learned from; score from which a document counts as good.
FOLD, GOOD = (5, 0), 0.3


class Model(NamedTuple):
    good: bytes
    bad: bytes
    score: Logistic | None


def blocks(data: bytes) -> list[bytes]:
    return [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of at most DICTIONARY bytes; of few or short samples, their text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=COVER_K, d=COVER_D).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


class Measure:
    """Sizes of a text compressed block by block with either dictionary and with none."""

    def __init__(self, good: bytes, bad: bytes):
        def compressor(content: bytes):
            d = zstandard.ZstdCompressionDict(content) if content else None
            if d is not None:
                d.precompute_compress(LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.each = [compressor(c) for c in (good, bad, b"")]

    def sizes(self, data: bytes) -> list[int]:
        """Compressed bytes with the good dictionary, with the bad one, and with none."""
        return [sum(len(c.compress(b)) for b in blocks(data)) for c in self.each]

    def __call__(self, data: bytes) -> list[float]:
        good, bad, plain = self.sizes(data)
        n = max(1, len(data))
        return [(bad - good) / n, float(np.log(plain / n + 0.001))]


def fit(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = FOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Dictionaries and score from at most SAMPLE labelled rows of each class (1: good) outside the fold.

    Half of them give blocks for the dictionaries, the others fit the score. Blocks are
    taken in the order of their hashes, equal ones alike, so the same rows give the same
    model. Where a class is missing the model has no score and judges every text alike.
    """
    sample = cut(labelled_sample(docs, labels, label_col, fold, SAMPLE, id_col, text_col).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int")))
    cutter = text_pass(sample.where("part = 0"), lambda: lambda texts: [{"blocks": blocks(t)} for t in texts], "blocks array<binary>", "text", ["label"])
    each = cutter.select("label", F.explode("blocks").alias("block"))
    taken = {k: [r.block for r in each.where(F.col("label") == k).orderBy(F.xxhash64("block"), "block").limit(BLOCKS).collect()] for k in (0, 1)}
    if not taken[0] or not taken[1]:
        return Model(b"", b"", None)
    good, bad = (train_dictionary([bytes(b) for b in taken[k]]) for k in (1, 0))

    def make():
        measure = Measure(good, bad)
        return lambda texts: [{"x": measure(t)} for t in texts]

    rows = text_pass(sample.where("part = 1"), make, "x array<double>", "text", ["label"]).collect()
    if len({r.label for r in rows}) < 2:
        return Model(good, bad, None)
    return Model(good, bad, Logistic(np.array([r.x for r in rows]), np.array([r.label for r in rows])))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row, whole texts, of any length, block by block.

    Null counts as empty; an empty text has sizes 0 and scores as a text that is all
    repetition. Equal texts have equal scores and repeated rows stay; an empty table gives
    no rows, other columns play no part. 0.5 throughout if the model has no score.
    """
    good, bad, calibrated = model

    def make():
        measure = Measure(good, bad)
        if calibrated is None:
            return lambda texts: [{"score": 0.5} for _ in texts]
        return lambda texts: [{"score": float(p)} for p in calibrated([measure(t) for t in texts])]

    return text_pass(docs, make, "score double", text_col, [id_col])


def op5_compression(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(remainder("doc_id", FOLD[0]) == FOLD[1], F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"))
