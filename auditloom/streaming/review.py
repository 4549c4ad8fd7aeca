"""Reviews as streams of requirement files, with events and a latest-answer view."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import review


def review_stream(rows: DataFrame, evaluate: Callable[[DataFrame], DataFrame], critic: Callable[[DataFrame], DataFrame], path: str) -> tuple[DataFrame, DataFrame]:
    """Evaluate a stream of requirements; gives (evaluations, events) of the finished run.

    Each micro-batch writes its evaluations and one event per row under its batch
    number, so a batch that runs again replaces its own output.  The critic
    starts only when the stream has ended (T4); then come critic_complete, done.
    """
    spark = rows.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        made = evaluate(batch).withColumn("batch", F.lit(number))
        made.write.mode("overwrite").parquet(f"{path}/evaluations/batch={number}")

    query = rows.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    evaluations = spark.read.option("basePath", f"{path}/evaluations").parquet(f"{path}/evaluations")
    total = evaluations.count()
    # numbered inside each micro-batch; only the batches' sizes, one row each, are summed in one task
    sizes = evaluations.groupBy("batch").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(review.Window.orderBy("batch").rowsBetween(review.Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(review.Window.partitionBy("batch").orderBy("requirement_id"))
    numbered = evaluations.join(F.broadcast(sizes), "batch").withColumn("seq", (place + F.col("_before")).cast("int")).drop("batch", "_before")
    payload = F.to_json(F.struct(F.struct(*[c for c in numbered.columns if c != "seq"]).alias("evaluation"), F.col("seq").alias("progress"), F.lit(total).alias("total")))
    events = numbered.select("seq", F.lit("evaluation").alias("event"), payload.alias("data"))
    reviewed = critic(numbered)
    tail = [(total + 1, "progress", json.dumps({"status": "running_critic"})), (total + 2, "critic_complete", json.dumps({"evaluations": total})), (total + 3, "done", "{}")]
    events = events.unionByName(spark.createDataFrame(tail, "seq int, event string, data string"))
    return reviewed, events


def progress_events(steps: list[tuple[str, Callable[[], str]]]) -> Iterator[dict]:
    """Run named steps in order and tell of each; an error ends them as extraction_error."""
    total = len(steps)
    for n, (name, run) in enumerate(steps, 1):
        try:
            detail = run()
        except Exception as e:  # the stream reports what broke a step
            yield {"type": "extraction_error", "step": name, "step_number": n, "total_steps": total, "detail": str(e)}
            return
        yield {"type": "extraction_progress", "step": name, "step_number": n, "total_steps": total, "detail": detail}
    yield {"type": "complete", "step": "complete", "step_number": total, "total_steps": total, "detail": ""}


def mock_stream(evaluations: DataFrame, on_event: Callable[[dict], None], order: str = "requirement_id", period: str = "600 milliseconds") -> int:
    """Hand one stored evaluation a period to on_event, then the phases critic and complete; gives how many there were.

    A micro-batch is one tick and holds one row, so nothing grows in the driver;
    an error of on_event ends the stream and is raised.
    """
    spark = evaluations.sparkSession
    place = F.row_number().over(review.Window.orderBy(order)) - 1  # a mock is one reviewer's session, so one task orders it
    rows = evaluations.withColumn("_tick", place.cast("long")).persist()
    total, ended = rows.count(), threading.Event()

    def one(batch: DataFrame, number: int) -> None:
        for row in batch.collect():
            seen = row.asDict()
            tick = seen.pop("_tick")
            on_event({"event": "evaluation", "evaluation": seen, "completed": tick + 1, "total": total})
            if tick + 1 == total:
                ended.set()

    try:
        if total:
            ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
            query = ticks.select(F.col("value").alias("_tick")).join(rows, "_tick").writeStream.foreachBatch(one).trigger(processingTime=period).start()
            while query.isActive and not ended.wait(0.05):
                pass
            if query.exception():
                raise query.exception()
            query.stop()
    finally:
        rows.unpersist()
    for phase in ("critic", "complete"):
        on_event({"event": "phase", "phase": phase})
    return total


def latest_by_key(stream: DataFrame) -> DataFrame:
    """Stream (key, seq, value) to updates (key, seq, value, n), the latest of each key so far and how many came."""
    return stream.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"), F.count("*").alias("n"))


def drain(updates: DataFrame, path: str, mode: str = "update") -> DataFrame:
    """Run an updates stream over what its source holds and read all its batches back.

    Each batch is written under its number, so one that runs again replaces
    itself; the column batch tells their order.
    """
    spark = updates.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    updates.writeStream.foreachBatch(one).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*updates.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).option("basePath", f"{path}/out").parquet(f"{path}/out")


def windowed(stream: DataFrame, ts: str, key: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per key and event-time window, for streams that have event time."""
    return stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late).groupBy(F.window("_t", length), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
