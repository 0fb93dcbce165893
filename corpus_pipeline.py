"""A corpus pipeline over ``documents``: stages in order, each written as a table and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenorline.llm import decontaminate, importance, jaccard, mixing, token_files
from tenorline.llm.runtime import cut, prepare, table
from tenorline.llm.workload import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the draw by importance keeps."""
    prepare(spark)
    return importance.good_documents(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones."""
    prepare(spark)
    return jaccard.one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    prepare(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document in the token files."""
    prepare(spark)
    return token_files.encode_and_read(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("near copies", near_copies), ("decontamination", decontamination), ("source mixing", mix), ("token output", tokens)]

# SQL expresses neither the fitted classifier nor the tokenizer; tests compare run() with a plain Python version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents below ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
