"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's docs. All but the last return the columns of documents: the quality classifier drops what
it rejects, exact deduplication keeps one row of equal texts, the n-gram join keeps one document of
each group of near copies, the secret scan masks what it finds, and packing gives the pieces' places.

Defined results: a null text is the empty text for every decision (and stays null until packing, where it
is a piece with only the end id); a null id ranks after all others when one row of a group is kept; of
equal texts the smallest id stays, and of rows that repeat both id and text one; empty texts are scored
like any others, link with nothing, and are equal to each other; texts of any length go through whole;
nulls in other columns are kept; extra columns, whatever they are called, pass through all stages but the
last; an empty table gives no rows. Without labels to learn from, or with label 1 nowhere, the quality
stage rejects all documents (every score is the prior, 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockloom.llm import bayes_jaccard, crf_secrets, grace_dedup, quality_pu, slack_packing
from blockloom.llm.shared import read_table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_pu.keep(docs, quality_pu.train(docs, read_table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return grace_dedup.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bayes_jaccard.keep(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return crf_secrets.redact(docs, crf_secrets.train(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return slack_packing.pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]

#: SQL can't express the classifiers, the tokenizer and the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; tables between them go to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
