"""The corpus pipeline: five stages over documents, each written as Parquet and read again before the next.

Every stage takes all rows that the one before kept, whole texts, and any further columns; an empty table goes through all
of them as one. What each does with nulls and odd rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quayside.llm import langid, minhash, mixing, packing, secrets
from quayside.plans.runtime import discard, materialize, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go: null texts, texts without a letter, and texts that are labelled with
    less certainty than 0.3. Null ids and repeated rows are judged one by one."""
    return langid.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8. Texts without words and rows
    without an id stay; of rows that repeat an id and its text one stays, and different texts under one id are different
    documents."""
    return minhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars counts the new text. No row goes; a null text stays null."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: documents in order of position, repeated or cut as their source's target asks. Documents without
    words take no part in it and go; a null source is a source of its own; rows that repeat a document are documents."""
    return mixing.stream(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens: every token of every row is in one piece; a text without tokens is its end token.
    Sequences ascend in the order of training that the mix has stored."""
    return packing.pack_in_order(docs)


STAGES = [("language ID", identify_language), ("near-dedup", deduplicate), ("secret scans", redact_secrets), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Trained and hashed stages cannot be written in SQL; tests/llm hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables and its input are deleted once its output is written."""
    docs, stored = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(STAGES):
        with scratch() as made:
            docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            with scratch() as output:
                docs = materialize(docs, f"pipeline-{k}")
            discard(spark, made + stored)
            stored = output
    return docs
