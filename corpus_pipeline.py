"""The corpus pipeline: five operators in a row over ``documents``.

``run`` writes what each stage keeps as Parquet in the shared folder of the session
(``spark.checkpoint.dir``) and reads it back as the next stage's input.  All stages but
the last return the columns of ``documents``; the last adds ``sample_weight``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorelens.llm import decontaminate, mixing, quality, secret_scan, simhash
from scorelens.sources.sinks import stage
from scorelens.sources.tables import read_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts: good and not toxic."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("keep").select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark (``n_chars`` follows)."""
    return secret_scan.redact(docs, length_col="n_chars")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample calibrated to the target margins, with ``sample_weight``."""
    return mixing.mix(docs).select(*docs.columns, "sample_weight")


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_redaction),
    ("mixing sources to target weights", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), "pipeline_" + name.replace(" ", "_"))
    return docs


# A trained classifier is not SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None
