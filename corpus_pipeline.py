"""The corpus pipeline: documents to a training mix, in stages that each call one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as a table in the
shared folder and reads it back as the next one's documents, so a lost executor costs at most its own stage. All
stages but the last return the columns of documents. Those with Python on executors hold the session's Arrow batches to
a few MB, so that an executor's memory does not follow the length of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from capweave.llm import decontam, langid, linededup, mix, simhash
from capweave.llm.common import small_batches, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with a posterior under one half, go."""
    small_batches(spark)
    return langid.accepted(docs, langid.train(docs.where(~langid.held_out())))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines leave their texts; n_chars follows the text."""
    return linededup.relined(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each near-duplicate group stays."""
    small_batches(spark)
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    small_batches(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with mix_copies and mix_finish, in global training order."""
    return mix.mixed_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: Language ID, SimHash and the mix's shuffle have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
