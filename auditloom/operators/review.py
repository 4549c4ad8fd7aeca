"""Evaluations: critic, reviewer edits, hierarchy, integrity, display and export rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import ANSWERS

CONFIDENCE, PAGE_THRESHOLD, APPROVABLE = 0.7, 20, 0.8


def route(pages: DataFrame, docs: DataFrame, threshold: int = PAGE_THRESHOLD) -> DataFrame:
    """doc_type by the number of pages with a text."""
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    kind = F.when(F.col("n_pages") > threshold, "compliance").otherwise("narrative")
    return docs.select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("n_pages", F.lit(0)).alias("n_pages")).withColumn("doc_type", kind)


def low_confidence(evaluations: DataFrame, requirements: DataFrame, threshold: float = CONFIDENCE) -> DataFrame:
    """What the critic reads."""
    low = evaluations.where(F.col("confidence") < threshold)
    text = requirements.select(F.col("id").alias("requirement_id"), F.col("text").alias("requirement_text"))
    return low.join(text, "requirement_id", "left").select("requirement_id", F.coalesce("requirement_text", F.lit("(unknown)")).alias("requirement_text"), F.col("answer").alias("agent_answer"), F.col("citation_text").alias("citation"), F.col("source_file").alias("source"), "confidence")


def apply_verdicts(evaluations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts (requirement_id, seq, verified_answer, needs_human_review, reason) in order of seq.

    The last evaluation of an id takes them (column seq of evaluations); unknown
    ids do nothing; a verdict's answer that is none of the three sets the flag only.
    """
    last = F.row_number().over(Window.partitionBy("requirement_id").orderBy(F.desc("seq"))) == 1
    rows = verdicts.groupBy("requirement_id").agg(F.sort_array(F.collect_list(F.struct("seq", "verified_answer", "needs_human_review", "reason"))).alias("_v"))
    df = evaluations.withColumn("_last", last).join(rows, "requirement_id", "left")
    start = F.struct(F.col("answer").alias("answer"), F.col("reasoning").alias("reasoning"), F.col("needs_human_review").alias("flag"))

    def step(s, v):
        answer = F.lower(F.coalesce(v["verified_answer"], F.lit("")))
        changed = answer.isin(*ANSWERS) & (answer != s["answer"])
        return F.struct(F.when(changed, answer).otherwise(s["answer"]).alias("answer"), X.critic_suffix(s["reasoning"], v["reason"], changed).alias("reasoning"), F.coalesce(v["needs_human_review"], F.lit(False)).alias("flag"))

    df = df.withColumn("_r", F.when(F.col("_last") & F.col("_v").isNotNull(), F.aggregate("_v", start, step)).otherwise(start))
    return df.withColumn("answer", F.col("_r.answer")).withColumn("reasoning", F.col("_r.reasoning")).withColumn("needs_human_review", F.col("_r.flag")).drop("_last", "_v", "_r")


def patch(evaluations: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """Fields of patches that are not null replace those of evaluations; one patch per key."""
    fields = [c for c in patches.columns if c not in keys]
    renamed = patches.select(*keys, *(F.col(c).alias(f"_{c}") for c in fields))
    df = evaluations.join(renamed, keys, "left")
    for c in fields:
        df = df.withColumn(c, F.coalesce(f"_{c}", c))
    return df.drop(*(f"_{c}" for c in fields))


def edit_patch(edits: DataFrame) -> DataFrame:
    """Reviewer actions (keys, action, answer, citation_text, notes) as patches; a rejection without a note does nothing."""
    saved = F.col("action") == "edit"
    status = F.when(F.col("action") == "approve", "approved").when(saved, "edited").when((F.col("action") == "reject") & ~X.blank(F.col("notes")), "rejected")
    notes = F.when(saved | (status == "rejected"), F.col("notes"))
    df = edits.withColumn("status", status).withColumn("reviewer_notes", notes)
    return df.withColumn("answer", F.when(saved, F.col("answer"))).withColumn("citation_text", F.when(saved, F.col("citation_text"))).drop("action", "notes").where("status IS NOT NULL")


def bulk_status(evaluations: DataFrame, ids: DataFrame, status: str = "approved") -> DataFrame:
    """Set the status of listed requirement ids, rejected ones too; `touched` marks them."""
    hit = ids.select("requirement_id").distinct().withColumn("_hit", F.lit(True))
    df = evaluations.join(hit, "requirement_id", "left").withColumn("touched", F.coalesce("_hit", F.lit(False))).drop("_hit")
    return df.withColumn("status", F.when(F.col("touched"), status).otherwise(F.col("status")))


def approvable(evaluations: DataFrame) -> DataFrame:
    """P7."""
    return evaluations.where((F.col("confidence") >= APPROVABLE) & ~F.col("needs_human_review") & (F.col("status") != "approved"))


def fallbacks(evaluations: DataFrame) -> DataFrame:
    """P14."""
    return evaluations.where(F.col("needs_human_review") & (F.col("confidence") == 0) & (F.col("source_file") == ""))


def export_rows(evaluations: DataFrame, requirements: DataFrame) -> DataFrame:
    """The twelve export columns and seq, their order."""
    r = requirements.select(F.col("id").alias("requirement_id"), F.col("text").alias("requirement_text"), "reference")
    df = evaluations.join(r, "requirement_id", "left")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return df.select("seq", "requirement_id", empty("requirement_text"), empty("reference"), "answer", "confidence", "citation_text", "source_file", "page_number", "needs_human_review", "status", "reviewer_notes", "reasoning")


def latest(evaluations: DataFrame) -> DataFrame:
    """The last evaluation of each requirement."""
    return evaluations.withColumn("_n", F.row_number().over(Window.partitionBy("requirement_id").orderBy(F.desc("seq")))).where("_n = 1").drop("_n")


def display_rows(requirements: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Requirement order; a requirement without an evaluation is pending."""
    df = requirements.select("id", "text", "reference").join(latest(evaluations).withColumnRenamed("requirement_id", "id"), "id", "left")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    shown = F.when(F.col("confidence").isNotNull(), F.format_string("%d%%", F.floor(F.col("confidence") * 100 + 0.5)))
    return df.select("id", "text", empty("reference"), empty("answer"), F.coalesce(shown, F.lit("")).alias("confidence_text"), empty("citation_text"), F.coalesce("status", F.lit("pending")).alias("status"), F.when(F.col("confidence").isNotNull(), X.confidence_tier(F.col("confidence"), F.col("needs_human_review"))).alias("tier"))


def hierarchy(requirements: DataFrame, sections: DataFrame, n_parts: int | None = None) -> DataFrame:
    """Requirements (doc_id, seq, section_heading, ...) with id and parent_id.

    A requirement of level 3 or deeper has the last one of level 2 or less before
    it as parent; an unknown heading counts as 0; of equal headings the last counts.
    Headings, some per document, are never broadcast; with n_parts, rows are dealt
    into so many in every step.
    """
    dealt = lambda df, *keys: df.repartition(n_parts, *keys) if n_parts else df
    at = ("doc_id", "section_heading")
    level = dealt(sections.select("doc_id", F.col("heading").alias("section_heading"), "level", "section_no"), *at).groupBy(*at).agg(F.max_by("level", "section_no").alias("_level"))
    df = dealt(requirements.withColumn("section_heading", F.coalesce("section_heading", F.lit(""))), *at).join(level.hint("merge"), list(at), "left").withColumn("level", F.coalesce("_level", F.lit(0))).drop("_level")
    seq = Window.partitionBy("doc_id").orderBy("seq")
    df = dealt(df, "doc_id").withColumn("id", F.row_number().over(seq))
    top = F.last(F.when(F.col("level") <= 2, F.col("id")), ignorenulls=True).over(seq.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("parent_id", F.when(F.col("level") >= 3, top))


def orphans(evaluations: DataFrame, requirements: DataFrame) -> DataFrame:
    """Evaluations of no known requirement."""
    return evaluations.join(requirements.select(F.col("id").alias("requirement_id")), "requirement_id", "left_anti")


def orphan_parents(requirements: DataFrame) -> DataFrame:
    """Requirements whose parent is no row of their document."""
    return requirements.where("parent_id IS NOT NULL").join(requirements.select("doc_id", F.col("id").alias("parent_id")).distinct(), ["doc_id", "parent_id"], "left_anti")


def startable(status: str) -> bool:
    """A review may start while extracting or reviewing."""
    return status in ("extracting", "reviewing")
