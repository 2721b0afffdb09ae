"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, encoding; each stage written and read again.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import exact_dedup, language_id, mixing, piece_tokens, simhash
from factorloom.llm.scratch import cleared, documents, last_written, written

#: Shares of the tokens to read. The tokens of the good domain set the total, so that it is read whole.
TARGETS = {"high": 0.95, "low": 0.05, "toxic": 0.0}


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: those without a letter, and those no nearer to any language's prototype than chance is."""
    return language_id.recognised(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_distinct(docs, keep="max")


def distinct_fingerprints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are read once or not at all: rates are at most 1, and what is left of a rate is drawn by a hash. With that the targets are out of reach, and the ridge keeps the cut between what is read and what is not soft."""
    good = lambda members: members.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("p_high")), F.lit(0.0))).first()[0] / TARGETS["high"]
    return mixing.resampled(docs, mixing.table_labels(spark, sf_dir), TARGETS, total=good, max_rate=1.0, ridge=1e-3)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the tokens, as op6 gives them."""
    return piece_tokens.round_trip(docs, piece_tokens.public_model())


STAGES = [("language id", known_language), ("exact dedup", distinct_texts), ("simhash near-dedup", distinct_fingerprints), ("mixing", mixed), ("sentencepiece", encoded)]
#: The stages are no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has written for itself goes once its result is a table."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with cleared(spark) as kept:
            docs = written(stage(spark, docs, sf_dir), f"stage{i}")
            kept.add(last_written())
    return STAGES[-1][1](spark, docs, sf_dir)
