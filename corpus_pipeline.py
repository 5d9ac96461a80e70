"""Corpus pipeline: quality, near duplicates, benchmark leaks, personal data, tokens.

Each stage takes the whole of what the one before kept, as a Parquet table with
the columns of ``documents``, and its decisions take effect.  Every stage decides
row by row: rows with null or repeated ids are judged, dropped and returned like
any other, columns beside those of ``documents`` pass through whatever their
names, texts of any length are taken whole, and an empty table gives an empty
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdatrace.llm import bpe, decontaminate, neardup, pii, quality
from verdatrace.llm.common import read, settle
from verdatrace.llm.queries import GOOD, tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from labelled documents among them, does not reject.

    A null text is scored as the empty one, which gets the model's prior; repeated
    rows get equal scores, so all stay or go; without labels all stay.
    """
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")), GOOD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near copies.

    All null and wordless texts are one group; a document with an id goes before
    one without, of rows alike in id and text one stays.
    """
    return neardup.keep_first(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Null and wordless texts have no window and stay; a row that has one goes,
    whether or not it has an id and whatever other rows share that id.
    """
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data and ``n_chars`` of the new text.

    Null and empty texts stay as they are; equal values get equal pseudonyms in
    all rows, repeated ones included.
    """
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and the digests of ids and decoded bytes.

    A null text counts as empty and has no ids; each row gives a row.
    """
    return bpe.round_trip(docs, *tokenizer(), ids="ids")


STAGES = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_leaks),
    ("pii_pseudonyms", personal_data),
    ("byte_bpe", tokens),
]

#: Fitting, fingerprints and byte merges have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
