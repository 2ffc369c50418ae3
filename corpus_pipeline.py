"""From raw documents to packed sequences, in stages that each work on all that the one before kept.

Rows with null or empty texts fail the quality rules.  Rows of one doc_id, null included, are one document to line
deduplication and the n-gram join: if another document of its group stays, all of them go.  Repeated rows are mixed and
packed one by one.  Empty tables give empty results.  Very long texts are read whole in every stage; ties go as each
stage's operator says; columns of documents other than doc_id, text, source and n_chars are only passed on, up to the last
stage, which returns places of pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.line_dedup import line_dedup
from trackloom.llm.mixing import mix_sources
from trackloom.llm.ngram_join import ngram_join
from trackloom.llm.packing import best_fit_packing
from trackloom.llm.quality_rules import fit_quality_trees, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, fit_quality_trees(docs, labels), keep_columns=True)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents share."""
    out = line_dedup(docs).drop("n_lines", "n_dropped")
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    groups = ngram_join(docs, n=5, percent=80, every_link=False)
    gone = groups.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document taken twice is two rows."""
    return mix_sources(docs, rows=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return best_fit_packing(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_join", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Trees, near-duplicate groups and packing are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
