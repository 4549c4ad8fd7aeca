"""The flagship: documents to chunks, vectors, ranked passages, evaluations and export rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import models
from ..operators import pack, review, similarity
from ..sources.shared import settle
from .document_queries import _files, line_units

TOP_K = 3


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents with an id and a vector, written once as the passage table."""
    chunks = pack.chunk(_files(spark, sf_dir), split=line_units)
    numbered = chunks.withColumn("id", F.xxhash64("source_file", "chunk_index"))
    return settle(models.embed(numbered, "text"), "passages")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items as requirements, each with its TOP_K passages."""
    corpus = passages(spark, sf_dir)
    items = settle(models.embed(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), "text"), "text"), "items")
    found = similarity.top_k(items.select("id", "vec"), corpus.select("id", "vec"), TOP_K)
    return found.withColumnRenamed("id", "chunk_id").join(corpus.select(F.col("id").alias("chunk_id"), "text", "source_file", "page_number"), "chunk_id")


def flagship_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export rows of a review of all benchmark items against all documents."""
    best = ranked(spark, sf_dir).where("rank = 1").withColumnRenamed("query_id", "requirement_id")
    made = models.RuleEvaluator().evaluate(best).withColumn("seq", F.col("requirement_id"))
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), "text", F.lit(None).cast("string").alias("reference"))
    return review.export_rows(made, asked)


def ranked_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).select("query_id", "rank", "similarity", "source_file", "text")


QUERIES = {"flagship_review": (flagship_review, None), "ranked_passages": (ranked_passages, None)}
