"""A corpus pipeline of five stages: language ID, quality classifier, n-gram Jaccard join, benchmark decontamination, packing.

Each stage is a function of (spark, docs, sf_dir) and gets what the stage before it kept. All but the last return the columns of ``documents``. Columns beyond those
are dropped by the first stage; null texts, repeated rows and empty tables are treated as the operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgrove.llm.common import scratch
from voxelgrove.llm.decontaminate import find_contamination
from voxelgrove.llm.jaccard_join import jaccard_groups
from voxelgrove.llm.language_id import UNKNOWN, identify_languages
from voxelgrove.llm.packing import pack_documents
from voxelgrove.llm.quality_fm import PREDICT_AT, classify_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language is rejected when it is unknown or less sure than this; four languages taken at random would have 0.25.
LEAST_SURE = 0.28


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the classifier knows; those without a letter or too unsure go."""
    found = identify_languages(docs.select(*COLUMNS))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SURE)).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the factorisation machine predicts to be good."""
    found = classify_quality(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.where(F.col("score") >= PREDICT_AT).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near-duplicates; rows that repeat an id and its text are one document."""
    docs = docs.select(*COLUMNS)
    groups = jaccard_groups(docs)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("_rows"))
    joined = docs.join(kept.withColumnRenamed("doc_id", "_kept"), F.col("doc_id").eqNullSafe(F.col("_kept")))
    if kept.where("_rows > 1").isEmpty():
        return joined.select(*COLUMNS)
    repeated = joined.where("_rows > 1").select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    return joined.where("_rows = 1").select(*COLUMNS).union(repeated)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a window of a benchmark item."""
    found = find_contamination(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS)
    return found.where("n_hit = 0").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; a row for each piece."""
    pieces = pack_documents(docs.select(*COLUMNS), keep=["doc_id"])
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("quality", quality), ("ngram_jaccard_join", deduplicate), ("decontaminate", decontaminate), ("packing", packing)]

#: SQL can't express the classifiers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{scratch(spark)}/voxelgrove/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{path}/{k}_{name}")
            docs = spark.read.parquet(f"{path}/{k}_{name}")
    return docs
