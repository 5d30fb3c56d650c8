"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm.common import shared_dir, table
from helixframe.llm.decontaminate import decontaminate
from helixframe.llm.jaccard import near_dedup
from helixframe.llm.line_dedup import line_dedup
from helixframe.llm.quality import quality_filter
from helixframe.llm.sentencepiece_codec import encode_texts

#: SimHash fingerprints, XXH64 and piece ids have no counterpart in SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break the quality rules go."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in many documents stay in one."""
    return line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: by SimHash first, then of those left by their five-word shingles."""
    return near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a share of benchmark passages go; from the others the passages go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), mode="both")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its piece ids, which are decoded again at once; ids that don't give the text back stop the pipeline."""
    return encode_texts(docs, check=True)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("sentencepiece encoding", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
