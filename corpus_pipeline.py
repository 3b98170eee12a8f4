"""A corpus from documents to packed sequences: quality, near copies, secrets, source mix, packing.

Every stage takes the documents that its predecessor kept, as ``(spark, docs, sf_dir)``, and
returns a DataFrame that is written and read again before the next one. All but the last
return the columns of documents.

* ``quality``: documents that the weakly labelled scorer rejects go; others stay untouched.
* ``near_duplicates``: of documents that are at least 0.8 similar on five-word shingles,
  directly or over others, the one with the smallest id stays.
* ``secrets``: every secret span is replaced by a mask; no document goes.
* ``mixture``: documents repeat or drop out as the source targets ask.
* ``packing``: pieces of the remaining documents in sequences.

Every stage passes an empty table on, keeps extra columns up to the last, and treats nulls as its
operator does. SQL cannot express the first stage; tests compare the stages with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrascope.llm import circulant_minhash, dp_packing, entropy_mix, secret_scan, weak_quality
from terrascope.llm.common import table
from terrascope.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return weak_quality.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return circulant_minhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.masked(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return entropy_mix.repeated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dp_packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("packing", packing)]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
