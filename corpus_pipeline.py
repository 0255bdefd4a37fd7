"""Cleaning and packing of a text corpus: toxicity, copies, near copies, personal data, packing.

Each stage takes what its predecessor kept. The first three drop rows, the fourth
rewrites texts, and all four return the columns of documents; the last returns pieces of
token sequences. Null and empty texts pass the toxicity stage; of all of them one row
stays as a copy of the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia.llm import exact_dedup, packing, pii, simhash, toxicity
from provenia.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose toxicity score, learned from the labelled rows of docs, is below 0.7.

    Texts of any length are read whole. Null and empty texts have no hits and stay, equal
    texts have equal scores, repeated rows stay or go together. Without labels of both
    classes fixed terms and weights stand. An empty table stays empty; all columns stay,
    whatever their names.
    """
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space, that with the smallest doc_id.

    A null id comes after all others; of repeated rows with the smallest id one stays. Null
    and empty texts are one group. Long texts are compared in chunks. An empty table stays
    empty; all columns stay, whatever their names.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest doc_id.

    Texts link if SimHash fingerprints of their sets of five-word shingles tell a cosine of
    0.8 or more; links are transitive. Null and empty texts are one group, texts of fewer
    than five words are one shingle, repeated rows are copies, null ids come last. An
    empty table stays empty; all columns stay, whatever their names.
    """
    return simhash.drop_near_copies(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data in texts replaced by its kind; n_chars follows the text, where there is such a column.

    Every row stays, repeated ones too. Null and empty texts stay as they are, long texts
    are read line by line, of overlapping spans the first stands. An empty table stays empty.
    """
    names = docs.columns
    text = pii.redact(F.col("text"))
    done = docs.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names])
    if "n_chars" in names:
        kind = dict(docs.dtypes)["n_chars"]
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return done


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens.

    A null or empty text is one piece of its end token; long texts are cut; repeated rows
    are packed as often as they are there. An empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("personal_data", redact),
    ("packing", pack),
]
#: SQL can express neither the learned scores nor the fingerprints and tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each stage is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
