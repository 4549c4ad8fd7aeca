"""Queries that run as streams over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_path
from ..streaming import review as stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A pattern stands for the table, which may be one file or a folder of files."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _evaluate(batch: DataFrame) -> DataFrame:
    size = F.col("p_size")
    return batch.select(F.col("p_partkey").alias("requirement_id"), F.when(size > 30, "yes").when(size > 15, "partial").otherwise("no").alias("answer"), ((size % 100) / 100.0).alias("confidence"), (size < 10).alias("needs_human_review"))


def _critic(evaluations: DataFrame) -> DataFrame:
    return evaluations.withColumn("needs_human_review", F.col("needs_human_review") | (F.col("confidence") < 0.2))


def _reviewed(spark, sf_dir):
    return stream.review_stream(_source(spark, sf_dir, "part"), _evaluate, _critic, shared_path(spark, "review"))


def stream_evaluations(spark, sf_dir):
    return _reviewed(spark, sf_dir)[0].drop("seq")


def stream_events(spark, sf_dir):
    return _reviewed(spark, sf_dir)[1].groupBy("event").agg(F.count("*").alias("n"))


def stream_latest(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    events = _source(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), "value")
    updates = stream.drain(stream.latest_by_key(events), shared_path(spark, "latest"))
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("batch"), F.desc("n")))
    return updates.withColumn("_r", last).where("_r = 1").select("key", "seq", "value", "n")


def stream_windows(spark, sf_dir):
    counted = stream.windowed(_source(spark, sf_dir, "events"), "ts", "event_type")
    updates = stream.drain(counted, shared_path(spark, "windows"))
    return updates.groupBy(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type").agg(F.max("n").alias("n"))


QUERIES = {
    "stream_evaluations": (stream_evaluations, "SELECT p_partkey AS requirement_id, CASE WHEN p_size > 30 THEN 'yes' WHEN p_size > 15 THEN 'partial' ELSE 'no' END AS answer, (p_size % 100) / 100.0::double AS confidence, p_size < 10 OR (p_size % 100) / 100.0::double < 0.2 AS needs_human_review FROM part"),
    "stream_events": (stream_events, "SELECT 'evaluation' AS event, count(*) AS n FROM part UNION ALL SELECT unnest(['progress', 'critic_complete', 'done']), 1"),
    "stream_latest": (stream_latest, "SELECT user_id::varchar AS key, max(event_id) AS seq, arg_max(value, event_id) AS value, count(*) AS n FROM events GROUP BY ALL"),
    "stream_windows": (stream_windows, "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL"),
}
