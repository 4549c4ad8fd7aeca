"""Short documents to requirements by one model call each (S15), their event stream (T3), and concurrent preparation."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import agents
from ..functions import llmjson
from ..functions import text as X
from ..operators import lines, review, terms, xref
from ..sources import corpus
from ..sources.shared import settle
from ..sources.store import Table
from . import derived, manual_queries

# The steps of the event stream and what each tells.
STEPS = ("parsing", "extracting", "segmenting", "defining", "saving")
DETAILS = {
    "parsing": "Parsing document structure",
    "extracting": "Extracting requirements",
    "segmenting": "Segmenting sections",
    "defining": "Extracting term definitions",
    "saving": "Saving terms",
}
#: What stands before the document in the prompt; a client may cut there.
MARK = "\n\nDocument:\n"
PROMPT = (
    "List every duty of the plan in the document below, recommendations too, as a JSON array of objects with id (from 1), "
    "text (a question that begins with 'Does the P&P state that'), reference (where it stands) and category. Answer with the array alone."
)


class RuleClient:
    """The default client: sentences with an obligation phrase, as a model would answer; the category is the phrase's group."""

    def complete(self, prompt: str) -> str:
        document = prompt.split(MARK, 1)[-1].replace("\n", " ")
        found = []
        for sentence in (s.strip() for s in re.split(r"(?<=[.!?])\s+", document)):
            group = next((name for name, p in X.OBLIGATION_GROUPS.items() if re.search(p, sentence)), None)
            if group:
                text = f"Does the P&P state that {sentence.rstrip('.')}?"
                found.append({"id": len(found) + 1, "text": text, "reference": f"Item {len(found) + 1}", "category": group})
        return json.dumps(found)


def extract(docs: DataFrame, client: agents.Client | None = None, limits: agents.Limits | None = None) -> DataFrame:
    """docs (doc_id, text) to (doc_id, error, status, item_no, id, text, reference, category), one call a document.

    A document whose call fails, or whose answer is no JSON array, keeps one row
    without an item that says so in error or status.  A null text is an empty one.
    """
    prompts = docs.select("doc_id", F.concat(F.lit(PROMPT + MARK), F.coalesce("text", F.lit(""))).alias("prompt"))
    called = settle(agents.call_all(prompts, "prompt", client or RuleClient(), limits).drop("prompt"), "narrative")
    failed = called.where("error IS NOT NULL").select("doc_id", "error", F.lit("failed").alias("status"))
    return llmjson.requirements(called.where("error IS NULL")).unionByName(failed, allowMissingColumns=True)


def _told(step: str) -> dict:
    return {"type": "progress", "step": step, "step_number": STEPS.index(step) + 1, "total_steps": len(STEPS), "detail": DETAILS[step]}


def events(
    document: DataFrame, source_file: str, store: Table, client: agents.Client | None = None, limits: agents.Limits | None = None
) -> Iterator[dict]:
    """One marked document (doc_id, text) through five steps, each told before it runs, then complete with its requirements.

    Terms are for later look-ups alone, so what fails after the extraction is
    logged and left out; a failed extraction ends the stream as extraction_error.
    """
    yield _told("parsing")
    try:
        marked = settle(lines.to_lines(document), "lines")
        yield _told("extracting")
        body = lines.typed(marked).where("kind = 'body'")
        # one document's answer, so its rows are as few as one completion holds
        rows = extract(lines.to_text(body), client, limits).orderBy("item_no").collect()
        if bad := [r for r in rows if r["status"] != "ok"]:
            raise ValueError(bad[0]["error"] or f"the answer is {bad[0]['status']}")
    except Exception as e:  # the stream tells what ended it
        yield {"type": "extraction_error", "error": str(e)}
        return
    try:
        yield _told("segmenting")
        sections = settle(lines.merge_empty(lines.segment(marked)), "sections")
        yield _told("defining")
        found = settle(terms.all_terms(marked, sections), "terms")
        yield _told("saving")
        store.upsert(terms.term_rows(found.withColumn("source_file", F.lit(source_file))))
    except Exception as e:  # requirements do not depend on terms
        logging.getLogger(__name__).warning("terms of %s are left out: %s", source_file, e)
    items = [{c: r[c] for c in ("id", "text", "reference", "category")} for r in rows]
    yield {"type": "complete", "requirements": items, "total_requirements": len(items)}


def concurrently(jobs: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """Independent Spark jobs from threads of their own, with the caller's local properties; the first error is raised."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = {name: pool.submit(inherit(job)) for name, job in jobs.items()}
        return {name: job.result() for name, job in running.items()}


def prepare(marked: DataFrame) -> dict[str, DataFrame]:
    """What the extraction needs beside the sections: terms, flagged sections and the index of references, each written once."""
    sections = settle(lines.merge_empty(lines.segment(marked)), "sections")
    made = concurrently({
        "terms": lambda: settle(terms.all_terms(marked, sections), "terms"),
        "flagged": lambda: settle(lines.flag_obligations(sections), "flagged"),
        "index": lambda: settle(xref.index(sections), "index"),
    })
    return {"sections": sections, **made}


def counts(prepared: dict[str, DataFrame]) -> DataFrame:
    """Per document its sections, those kept and skipped, its terms and its reference keys."""
    flagged = prepared["flagged"].groupBy("doc_id").agg(
        F.count("*").alias("n_sections"), F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_skipped"))
    per = {name: prepared[name].groupBy("doc_id").agg(F.count("*").alias(out)) for name, out in (("terms", "n_terms"), ("index", "n_keys"))}
    return flagged.join(per["terms"], "doc_id", "left").join(per["index"], "doc_id", "left").na.fill(0, ["n_terms", "n_keys"])


def narrative_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = lines.to_text(lines.typed(derived.lines(spark, sf_dir)).where("kind = 'body'"))
    short = review.route(corpus.text_pages(body), body).where("doc_type = 'narrative'").select("doc_id")
    found = extract(body.join(short, "doc_id", "left_semi"), limits=agents.Limits(per_minute=0)).where("id IS NOT NULL")
    return found.select("doc_id", "id", "text", "reference", "category")


def preparation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(prepare(derived.lines(spark, sf_dir)))


_GROUP = " ".join(f"WHEN regexp_matches(sentence, '{p}') THEN '{name}'" for name, p in X.OBLIGATION_GROUPS.items())
NARRATIVE_SQL = rf"""WITH {derived.SECTIONS_SQL},
bodies AS (SELECT doc_id, string_agg(line, ' ' ORDER BY line_no) AS text FROM numbered WHERE kind = 'body' GROUP BY doc_id HAVING ceil(count(*) / 40.0) <= 20),
cut AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM bodies),
each_ AS (SELECT doc_id, unnest(ss) AS raw, generate_subscripts(ss, 1) AS k FROM cut),
judged AS (SELECT *, CASE {_GROUP} END AS category FROM (SELECT doc_id, k, trim(raw) AS sentence FROM each_)),
listed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS id FROM judged WHERE category IS NOT NULL)
SELECT doc_id, id::int AS id, 'Does the P&P state that ' || rtrim(sentence, '.') || '?' AS text, 'Item ' || id AS reference, category FROM listed"""
_OF = {name: manual_queries.QUERIES[name][1] for name in ("all_terms", "section_keys", "obligation_counts")}
COUNTS_SQL = f"""SELECT o.doc_id, total AS n_sections, kept AS n_kept, skipped AS n_skipped, coalesce(n_terms, 0) AS n_terms, coalesce(n_keys, 0) AS n_keys
FROM ({_OF['obligation_counts']}) o LEFT JOIN (SELECT doc_id, count(*) AS n_terms FROM ({_OF['all_terms']}) GROUP BY ALL) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_keys FROM ({_OF['section_keys']}) GROUP BY ALL) USING (doc_id)"""
QUERIES = {"narrative_requirements": (narrative_requirements, NARRATIVE_SQL), "preparation_counts": (preparation_counts, COUNTS_SQL)}
