"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read by the next.

Language identification drops what has no identifiable language; the quality classifier drops what it scores
under its threshold; exact dedup keeps the copy with the largest id; SimHash near-dedup keeps the document
with the smallest id of each component; packing returns the pieces of training sequences. All stages but the
last return the columns of documents. Each model learns from the documents its own stage is given.

Null and empty texts have no language and go in the first stage; texts of any length, repeated rows, ids that
several texts share, rows without an id and further columns, whatever their names, pass through all stages as
the operators say. An empty table gives no rows. Labels of one kind only are an error, not a reason to drop all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vellumspark.llm import exact_dedup, langid, packing, quality, simhash
from vellumspark.llm.queries import tokenizer_path
from vellumspark.session import checkpoint_dir, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.learn(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each_group(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language", language_stage), ("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("packing", packing_stage)]

#: The classifiers and the packing can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder; what a stage has read is deleted once its result is there."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{before}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = name
    return docs
