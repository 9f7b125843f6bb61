"""Corpus cleaning pipeline: five stages, each written as Parquet and read again as the next one's documents.

toxicity (rejected documents go) -> line dedup -> n-gram Jaccard join (the
smallest doc_id of each group of near copies stays) -> benchmark
decontamination (documents holding a benchmark window go) -> BPE encoding.
All stages but the last return the columns of ``documents``; the last one
returns doc_id, token count and digests of the ids and of the decoded text.
Empty tables, null texts and extra columns are handled as each operator's
module states.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketry.llm import bpe, decontaminate, jaccard, lines, toxicity
from basketry.llm.store import package_on_workers
from basketry.session import shared_root

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    package_on_workers(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    package_on_workers(spark)
    return lines.drop_repeated_lines(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    package_on_workers(spark)
    return jaccard.one_of_each(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    package_on_workers(spark)
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    package_on_workers(spark)
    return bpe.digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The toxicity model and the byte-pair merges are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{name}")
    return docs
