"""A corpus pipeline of five stages over `documents`. Each stage takes the documents that the
one before has written and works on all of them; its decisions take effect on what it returns.

quality: documents that the rules reject go. lines: lines of five sites or more go, but for
their first place. near_duplicates: of each group one document stays. mix: documents come in as
often as the mix takes them. pack: bins of 2048 words, as rows of placed pieces; doc_id, k1, k2,
copy and piece name the words of each, so packing.packed_texts() rebuilds the texts of the bins
from the mixed documents.

The stages' tables stay in this application's scratch folder until its owner calls
common.clear(), as the result reads the last one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kinespark.llm import line_dedup, mixing, near_dedup, packing, quality
from kinespark.llm.common import scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_low_quality(docs)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(docs, min_sites=5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs, width=5, percent=80, bands=24, rows=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, weights=(1, 2, 3), most=3)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, capacity=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", shared_lines),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit),
]

#: The shuffle hashes and the packing search have no SQL form; tests/llm holds every stage of
#: run() against a brute-force version of its rule.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}_{name}")
        docs = spark.read.parquet(f"{base}/{i}_{name}")
    return docs
