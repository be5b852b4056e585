"""From raw documents to packed training sequences.

``STAGES`` in order: documents that the toxicity model rejects go; lines that an earlier line equals or
nearly equals go; one document of each near-duplicate group stays; sources are mixed to target weights,
documents repeated or left out and put in training order; texts become sequences of at most 2048 tokens.
Each stage takes (spark, docs, sf_dir) and returns the columns of ``documents``, the last one pieces. A stage's
result is a table in the shared folder, from which the next one starts again if executors are lost.

Edge cases, by stage. Null ids: scored and kept by toxicity; their lines stay and remove none; in no group of
near duplicates, so kept; ordered as the empty string by mixing; packed under a null id. Null texts: scored
as empty; unchanged by line dedup; in no group; no words, so they go with their neighbours in the mix; packed as
one end token. Empty texts alike. A null source is a source of its own, last in order. Repeated ids: every row
is scored; lines count as earlier by line number; rows of one id are one document of a group, all kept
or none; mixed row by row. Very long texts are worked on whole. Empty tables give empty results in every stage, and
without labels nothing is rejected. Columns beside those used pass through every stage but the last, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestore.llm import line_dedup, mixing, near_dup, packing, toxicity
from tidestore.llm._frames import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_report(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer can't be put in SQL; a test compares every stage's rows, and ``run``, with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
