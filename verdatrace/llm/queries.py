"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdatrace.llm import bpe, ctw, decontaminate, licenses, mainpage, neardup, pii, quality, rules, secrets
from verdatrace.llm.common import read
from verdatrace.llm.oracles import ORACLES  # noqa: F401  (registered beside QUERIES)

#: Score from which on a document is good.
GOOD = 0.3


def tokenizer() -> tuple[str, str]:
    """Place of the rank file and the pattern that splits texts."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return bpe.round_trip(read(spark, sf_dir, "documents"), *tokenizer())


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document, having learned from labelled ones that are not held out."""
    docs = read(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of benchmark items cover."""
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return mainpage.main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of every document, taken as the file ``source/lang/doc_id``."""
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("lang", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return licenses.scan(docs, F.col("doc_id"), F.col("source"), path, F.col("text")).withColumnRenamed("key", "doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and perplexity limits for every document."""
    return rules.judge(read(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    found = neardup.classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; a source is an owner, a source's language a repository."""
    return secrets.scan(read(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document."""
    return ctw.score(read(spark, sf_dir, "documents"))


def _of_kind(kind: str) -> F.Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, and how many of each kind there are."""
    found = pii.redact(read(spark, sf_dir, "documents").select("doc_id", "text"), spans="spans")
    return found.select("doc_id", "text", F.size("spans").cast("bigint").alias("n_pii"), *(_of_kind(k) for k in pii.KINDS), F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_byte_bpe, op2_quality_classifier, op3_benchmark_decontamination, op4_html_extraction, op5_license_scan, op6_quality_rules, op7_simhash_near_dedup, op8_secret_scan, op9_lm_scoring, op10_pii_pseudonyms)
}
