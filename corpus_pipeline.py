"""A training-data pipeline: stages over the documents table, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.core.scratch import Scratch
from webloom.llm import exact_dedup, mixing, sentencepiece_codec, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, fitted on the labelled documents outside the fold, does not call toxic.
    Null and empty texts are judged as texts without terms; repeated rows stay or go together; an empty
    table stays empty; columns stay as they are, whatever their names."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that with the smallest doc_id; runs of white space count as one space and null
    as empty. Whole texts of any length are compared. An empty table stays empty; columns stay as they are."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles, similarity 0.8 or more, connect: that with
    the smallest doc_id. Null, empty and blank texts are one group. Rows without an id stay, and rows that
    share one stay or go together. An empty table stays empty; columns stay as they are."""
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards shares of count ** 0.5 a source, dealt and sorted by a hash. A null source is
    one of its own, and a null id draws like any other. An empty table stays empty; columns stay as they are."""
    return mixing.mix(docs).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns and `piece_ids`, the ids of the whole text; null and empty texts have none. A column of that
    name stays, and the new one gets an underscore. An empty table stays empty."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: A fitted model, fingerprints and an encoder are beyond SQL; a test holds all rows of run() against a
#: brute-force version of the five stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of `sf_dir`."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
