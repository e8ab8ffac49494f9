"""A corpus pipeline of five stages over ``documents``.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; what it returns is
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``, further columns included, whatever their
names; empty tables stay empty, and every text is read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from prismalake.llm import decontaminate, mixing, ngram_join, secret_scan, toxicity
from prismalake.llm.common import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    The model learns from those of ``docs`` that ``labels`` covers. Null and empty
    texts stay; rows without id are scored like others; repeated rows stay or go
    together; a score of exactly 0.5 goes.
    """
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: the smallest id, null last.

    Another text of the same id is another document. Null, empty and wordless
    texts link with nothing and stay once an id; rows that repeat id and text
    are one.
    """
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go.

    Each text is judged by itself, also without id; null and empty texts stay,
    and nothing goes if the benchmark is empty.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret values are replaced by a mark and ``n_chars`` follows; every document stays, null and empty texts as they are."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, in training order.

    Null and empty texts have size 0 and are not taken; a null source is a
    source; repeated rows are documents of their own.
    """
    return mixing.contract(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: The first two stages (a trained model, a similarity join) have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; a stage's table goes from the shared folder once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
