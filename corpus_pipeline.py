"""A corpus pipeline: toxic documents go, one of each group of near copies stays, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read
again as the next stage's docs, in the folder that the cluster shares. All but the last return the columns of documents.

Defined cases: a null or empty text is a text without words: it isn't toxic, it's a near copy of other such texts, and
mixing leaves it out, as it has no words to take; a null source is a source of its own; equal rows are near copies of each other; an
empty table gives an empty result; further columns of documents are carried along, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lakesift.llm import bpe, mixing, simhash, toxicity
from lakesift.llm.common import shared_folder, table


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity score rejects; the model is fitted on the labelled documents."""
    return toxicity.clean(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, repeated or left out as their source's target asks."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of tokens and digests of the ids and of the decoded text."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", keep_clean),
    ("SimHash near-dedup", keep_one_of_each),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]
#: The model and the ids of a tokenizer aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    name = uuid.uuid4().hex
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/pipeline-{name}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
