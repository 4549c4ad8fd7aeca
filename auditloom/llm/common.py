"""Shared pieces: the cluster's shared folder, written tables, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import read_table, shared_root

#: Characters that separate words, for btrim and translate.
WHITE = " \t\n\x0b\f\r"
#: A word, as a Java and RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in one Arrow batch; whole texts travel in them, so it is kept small.
BATCH_ROWS = 1024


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/auditloom/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


#: Tables of ids up to so many rows may be broadcast: 8 MB of ids.
BROADCAST_IDS = 1_000_000


def checked(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """A written table of ids, marked for broadcast if it has at most `limit` rows; beyond that it is joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= limit else ids


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) per node that is not its own root.

    Alternates the large-star and small-star steps until the edges no longer
    change.  Minima are pre-aggregated and written before they are joined back, so
    the join has shuffles of its own, which the planner splits where a hub's edges
    are many; each round is cut off by a written table.
    """
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m")), "low")
        large = settle(both.join(low, both.a == low.v).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = settle(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "v"), "low")
        small = large.join(low, large.a == low.v).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = settle(small.unionByName(low.select(F.col("v").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
