"""From documents to training sequences: toxic ones go, one of each group of near copies stays, sources are mixed to their
weights, and what is left is packed. Each stage takes (spark, docs, sf_dir); all but the last return documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandwork.llm.common import table, written
from strandwork.llm.jaccard_join import one_of_each
from strandwork.llm.mixing import mixed_rows
from strandwork.llm.packing import pack
from strandwork.llm.queries import TOXIC, vocabulary
from strandwork.llm.toxicity import learn, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, learn(docs, table(spark, sf_dir, "labels")), TOXIC)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies by shingles of five words and a similarity of 0.8."""
    return one_of_each(docs, size=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("jaccard_join", jaccard_join), ("mixing", mixing), ("packing", packing)]

#: Training, rounding by hashes and tokenizing can't be said in SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, _path = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
