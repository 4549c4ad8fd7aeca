"""Model calls of the review: section extraction, batches, question agents and the critic, under limits.

A client is any picklable object with complete(prompt) -> str.  Calls run on the
executors, several at a time in a task, each behind the task's share of the rate,
with retries of transient errors and a time limit.  What a call gives is text; it
is parsed by the column functions of `llmjson`, so a bad answer is a fallback or
no row, never a failed job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import llmjson
from .functions import text as X
from .operators import lines, review
from .sources.shared import settle
from .streaming import limiter

MAX_STEPS = 8


class Client(Protocol):
    """One completion of a prompt."""

    def complete(self, prompt: str) -> str: ...


@dataclass
class Limits:
    """Calls at a time in a task, calls a minute over all `tasks`, seconds a call, attempts and their first pause."""

    workers: int = limiter.REVIEW_WORKERS
    per_minute: float = limiter.REQUESTS_PER_MINUTE
    tasks: int = 1
    seconds: float = limiter.TIMEOUT_SECONDS
    attempts: int = 5
    base: float = 4.0
    jitter: float = 1.0


def transient(message: str) -> bool:
    """F34 for a message at hand."""
    return any(x in message.upper() for x in X.TRANSIENT)


def call_all(rows: DataFrame, prompt: str, client: Client, limits: Limits | None = None, out: str = "raw", error: str = "error") -> DataFrame:
    """rows with the client's answer to each prompt, or null and what went wrong; rows come back in order."""
    limits = limits or Limits()

    def one(text: str, bucket: limiter.TokenBucket) -> tuple[str | None, str | None]:
        def ask() -> str:
            bucket.acquire()
            return client.complete(text)

        def guarded() -> tuple[str | None, str | None]:
            try:
                return limiter.with_retries(ask, transient, limits.attempts, limits.base, jitter=limits.jitter), None
            except Exception as e:  # one failed call is one row's error
                return None, f"Agent error: {e}"

        return limiter.with_timeout(guarded, limits.seconds, (None, f"Worker error: Worker timed out after {limits.seconds:g}s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = limiter.shared(limits.per_minute, limits.tasks)
        with ThreadPoolExecutor(limits.workers) as pool:
            for batch in batches:
                made = list(pool.map(lambda t: one(t or "", bucket), batch.column(prompt).to_pylist()))
                texts, errors = (pa.array([m[k] for m in made], pa.string()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, texts, errors], names=[*batch.schema.names, out, error])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType()), T.StructField(error, T.StringType())]))


def evaluate(requirements: DataFrame, client: Client, limits: Limits | None = None, prompt: str = "prompt") -> DataFrame:
    """Requirements (requirement_id, prompt) to evaluations; a failed call is a flagged `no` with its cause."""
    called = settle(call_all(requirements.select("requirement_id", prompt), prompt, client, limits), "answers")
    good = llmjson.answers(called.where("error IS NULL").select("requirement_id", "raw"))
    bad = called.where("error IS NOT NULL").select(
        "requirement_id", F.lit("no").alias("answer"), F.lit("").alias("citation_text"), F.lit("").alias("source_file"), F.lit(0).alias("page_number"), F.lit(0.0).alias("confidence"), F.col("error").alias("reasoning"), F.lit(True).alias("needs_human_review"))
    return good.unionByName(bad)


def extract(sections: DataFrame, client: Client, limits: Limits | None = None) -> DataFrame:
    """Requirements of sections, one call each; a failed call gives none."""
    shown = X.section_text(F.col("heading"), F.col("page_start"), F.col("page_end"), F.col("text"), F.col("tables"))
    called = call_all(sections.select("doc_id", "section_no", F.col("heading").alias("section_heading"), shown.alias("prompt")), "prompt", client, limits)
    return llmjson.compliance(called.where("error IS NULL").drop("prompt", "error"))


def extract_batches(sections: DataFrame, client: Client, limits: Limits | None = None, max_chars: int = 800, max_count: int = 8) -> DataFrame:
    """Requirements of small sections, one call a batch."""
    entry = X.batch_entry(F.col("heading"), F.col("page_start"), F.col("text"), F.col("tables"))
    rows = sections.join(lines.batch_small(sections, max_chars, max_count), ["doc_id", "section_no"]).withColumn("_e", entry)
    rows = settle(rows.withColumn("batch_no", F.xxhash64("doc_id", "batch_no")), "batches")
    prompts = rows.groupBy("batch_no").agg(F.first("doc_id").alias("doc_id"), lines.joined("section_no", "_e", "\n").alias("prompt"))
    called = call_all(prompts, "prompt", client, limits)
    found = llmjson.batch(called.where("error IS NULL").select("batch_no", "raw"), rows.select("batch_no", "section_no", "heading"))
    return found.join(prompts.select("batch_no", "doc_id"), "batch_no").drop("batch_no")


def criticise(evaluations: DataFrame, requirements: DataFrame, client: Client, limits: Limits | None = None, size: int = 100) -> DataFrame:
    """Evaluations after the critic's verdicts on those of low confidence, `size` to a call; a failed call changes nothing."""
    low = review.low_confidence(evaluations, requirements).withColumn("_c", F.pmod(F.xxhash64("requirement_id"), F.greatest(F.lit(1), F.ceil(F.lit(review.low_confidence(evaluations, requirements).count()) / size))))
    items = low.groupBy("_c").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*[c for c in low.columns if c != "_c"])))).alias("items"))
    prompts = items.select("_c", F.concat(F.lit("Review these findings; answer with a JSON array of requirement_id, verified_answer, needs_human_review and reason:\n"), "items").alias("prompt"))
    called = settle(call_all(prompts, "prompt", client, limits), "verdicts")
    found = llmjson.verdicts(called.where("error IS NULL").select("_c", "raw")).where("requirement_id IS NOT NULL").drop("_c")
    return review.apply_verdicts(evaluations, found)


def run_steps(client: Client, task: str, tools: dict[str, Callable[..., str]], max_steps: int = MAX_STEPS) -> str:
    """A tool-calling loop: the client answers with {"tool", "arguments"} or {"final_answer"}; gives the final answer as JSON.

    What a tool gives, or the error it raises, is added to the prompt.
    """
    prompt = task
    for _ in range(max_steps):
        said = client.complete(prompt)
        try:
            step: Any = json.loads(said)
        except ValueError:
            return said
        if not isinstance(step, dict) or "tool" not in step:
            answer = step.get("final_answer", step) if isinstance(step, dict) else step
            return answer if isinstance(answer, str) else json.dumps(answer)
        try:
            found = tools[step["tool"]](**step.get("arguments", {}))
        except Exception as e:  # the model is told and may try again
            found = f"Error: {type(e).__name__}: {e}"
        prompt = f"{prompt}\n\n[{step['tool']}]\n{found}"
    raise RuntimeError(f"no final answer within {max_steps} steps")


@dataclass
class Agent:
    """A client whose completion is a whole tool-calling loop with fresh state."""

    client: Client
    tools: dict[str, Callable[..., str]]
    max_steps: int = MAX_STEPS

    def complete(self, prompt: str) -> str:
        return run_steps(self.client, prompt, self.tools, self.max_steps)


def each(evaluations: DataFrame, on_result: Callable[[Any], None]) -> int:
    """Hand every evaluation to a callback, partition by partition; gives how many there were."""
    n = 0
    for row in evaluations.toLocalIterator():
        on_result(row)
        n += 1
    return n
