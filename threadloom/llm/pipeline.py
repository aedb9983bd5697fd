"""The corpus pipeline: five stages, each written as Parquet to the shared folder and read again.

Documents that the language stage can't place or that the toxicity stage rejects go, one document
stays of each near-duplicate group, documents that overlap the benchmark go, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import decontaminate, language, sentencepiece, simhash, toxicity
from threadloom.llm.shared import no_guessed_broadcasts, small_rows
from threadloom.session import drop_path, materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a letter and a mean probability of 0.4 or more for one language, learned from ``docs`` itself.

    Null and letterless texts go, and with no labelled text all rows. Every column stays.
    """
    small_rows(spark)
    return language.keep_identified(docs, language.fit(docs), min_score=0.4)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored under 0.5 by a model of the labelled documents; all rows if there is no label. Null texts have the base score."""
    small_rows(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group of near copies; see :func:`simhash.keep_first` for nulls, ties and repeats."""
    small_rows(spark)
    with no_guessed_broadcasts(spark):
        return simhash.keep_first(docs, shingle=5, max_bits=4, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no benchmark item overlaps; null and empty texts and an empty benchmark match nothing."""
    small_rows(spark)
    return decontaminate.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_crc32, exact, ids)``, one row per row; null texts have no ids."""
    small_rows(spark)
    import public_tokenizers

    return sentencepiece.encode(docs, sentencepiece.load(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: Trained models and a merge-order segmentation are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; only the last stage's table is left in the shared folder.

    Each stage reads what its predecessor kept. Rows that repeat an id are judged by their own texts, extra columns
    of ``documents`` pass through to the last stage, and an empty table gives an empty result.
    """
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, written = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if path:
            drop_path(spark, path)
        path = written
    return docs
