"""Registered queries of this subpackage: each applies one operator, with production
parameters, to its whole table, and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import (collocations, decontaminate, fingerprint, html_extract, lm_score, mixing, negatives,
               quality, quality_rules, repeats, secret_scan, simhash, url_filter)
from .sql import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@_register
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "pattern")


@_register
def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select(
        "page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@_register
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality and toxicity probabilities and the verdict."""
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", "quality_score", "toxic_score", "keep")


@_register
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the documents labelled good and not toxic."""
    docs = read_table(spark, sf_dir, "documents")
    target = lm_score.labelled_target(docs, read_table(spark, sf_dir, "labels"))
    scored = lm_score.score(docs.select("doc_id", "text"), lm_score.fit(target, docs))
    return scored.select("doc_id", "n_tokens", "ce_target", "ce_background", "ce_difference")


@_register
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled documents with their cell, raked weight and probability."""
    out = mixing.mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"),
                      F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
                      "weight", "probability")


@_register
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), _hex16("fp").alias("fingerprint"), "component_id")


@_register
def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed",
                        F.size("spans").cast("bigint").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


@_register
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "entropy")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"),
                        secret_scan.spans_text(F.col("spans")).alias("spans"))


@_register
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it contains."""
    found = decontaminate.contaminated(read_table(spark, sf_dir, "documents"),
                                       read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"),
                        "n_shared", "n_item", "containment")


@_register
def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@_register
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best 2,000 phrases of two to four words."""
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


@_register
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and each of its positives."""
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"))


@_register
def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base figures and the cascade's verdict."""
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
