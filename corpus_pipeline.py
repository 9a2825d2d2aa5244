"""A training corpus from ``documents``, stage by stage.

Each stage works on all rows its predecessor kept, which were written as
Parquet and read again. ``run`` applies them in order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobsift.llm import line_dedup, mixing, simhash, toxicity
from jobsift.llm.common import read, shared_dir
from jobsift.llm.queries import bpe_digests
from jobsift.llm.sampling import fold

from pyspark.sql import functions as F

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents``, n_chars counted anew."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), fold("id", 3) != 1)
    return toxicity.without_toxic(docs, model)


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a source repeats on too many of its documents go."""
    return _documents(line_dedup.cleaned(docs.select(*COLUMNS)))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.one_of_each(docs.select(*COLUMNS), shingle=3, max_distance=2)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mixed(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mix."""
    return bpe_digests(docs)


STAGES = [("toxicity", toxic_out), ("line_dedup", lines_out), ("simhash", copies_out), ("mixing", mix), ("bpe", tokens)]

#: The classifier and the tokenizer have no SQL; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
