"""Documents to final requirements: the long-document path as one plan, and the tools of the review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import models
from ..functions import text as X
from ..operators import lines, review, similarity, terms, xref
from ..operators.lines import Window, joined
from ..sources.shared import parts_of, settle
from . import derived, manual_queries

#: The fields that count for completeness.
OPTIONAL = ["exact_quote", "obligation_type", "obligation_level", "actor", "action_required", "condition", "timeframe", "evidence_needed", "risk_area"]


def extract(marked: DataFrame, extractor: models.Extractor | None = None, threshold: float = similarity.DUPLICATE) -> DataFrame:
    """Marked lines to requirements (doc_id, id, parent_id, level, text, reference, …).

    Sections without an obligation are dropped before the extractor runs; rows
    come in order of (section, item), which makes duplicates' leaders, parents and
    ids the same in every run.  Lines are counted first; their number and length
    tell into how many partitions documents are dealt in every step.
    """
    n = parts_of(marked, "line")
    dealt = lambda df: df.repartition(n, "doc_id")
    sections = lines.sub_split(lines.merge_empty(lines.segment(dealt(marked))))
    sections = settle(sections.withColumn("section_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no", "piece_no"))).drop("piece_no"), "sections")
    kept = lines.flag_obligations(sections).where("kept")
    model = extractor or models.RuleExtractor()
    found = model.extract(kept).withColumn("kind", F.lit(0)).withColumn("a", F.lit(0)).withColumnRenamed("item_no", "b")
    # a table without a requirement column is a section of its own; its number rides along as the section's
    wide = F.struct("section_no", "table_no")
    other = model.extract(terms.unmapped_tables(kept).withColumn("section_no", wide).drop("table_no")).withColumnRenamed("item_no", "b").withColumn("kind", F.lit(1))
    other = other.withColumn("a", F.col("section_no.table_no")).withColumn("section_no", F.col("section_no.section_no"))
    tables = terms.requirement_rows(kept).withColumn("kind", F.lit(1)).withColumnRenamed("table_no", "a").withColumnRenamed("row_no", "b")
    both = found.unionByName(tables, allowMissingColumns=True).unionByName(other, allowMissingColumns=True)
    both = both.select("*", *(F.lit(None).cast("string").alias(c) for c in OPTIONAL if c not in both.columns))
    both = settle(dealt(both).withColumn("id", F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no", "kind", "a", "b")).cast("long")), "requirements")
    clusters = similarity.leaders(models.embed(both.select("doc_id", "id", "text"), "text").select("doc_id", "id", "vec"), threshold, "doc_id")
    keyed = both.select("doc_id", "id", "text", "reference", "section_heading", *OPTIONAL)
    merged = similarity.merge(keyed, clusters, OPTIONAL, "doc_id", n).drop("members")
    return review.hierarchy(merged.withColumnRenamed("id", "seq"), sections, n).drop("seq")


def contexts(marked: DataFrame) -> DataFrame:
    """Every section as its reader sees it, with the sections it refers to."""
    sections = lines.merge_empty(lines.segment(marked))
    shown = X.section_text(F.col("heading"), F.col("page_start"), F.col("page_end"), F.col("text"), F.col("tables"))
    extra = xref.context(xref.resolve_sections(sections))
    return sections.join(extra, ["doc_id", "section_no"], "left").select("doc_id", "section_no", F.concat_ws("\n", shown, "context").alias("text"))


def search(queries: DataFrame, corpus: DataFrame, top_k: int = similarity.TOP_K, embedder: models.Embedder | None = None) -> DataFrame:
    """Queries (id, text) against a corpus (id, text, source_file, page_number, vec): one formatted text each."""
    asked = models.embed(queries.select("id", "text"), "text", embedder)
    found = similarity.top_k(asked.select("id", "vec"), corpus.select("id", "vec"), top_k)
    rows = found.join(corpus.select("id", "text", "source_file", "page_number"), "id")
    rows = rows.withColumn("_t", X.result_text(F.col("rank"), F.col("similarity"), F.col("source_file"), F.col("page_number"), F.col("text")))
    made = rows.groupBy(F.col("query_id").alias("id")).agg(joined("rank", "_t", "\n---\n").alias("result"))
    return queries.select("id").join(made, "id", "left").withColumn("result", F.coalesce("result", F.lit("No relevant passages found in the policy corpus.")))


def define_terms(queries: DataFrame, known: DataFrame, top_k: int = 3, embedder: models.Embedder | None = None) -> DataFrame:
    """Queries (query) with one formatted text each: exact matches, else the top_k nearest terms, else that there are none.

    known are stored terms: those of terms.term_rows() with their fields.
    """
    asked = queries.select("query").distinct().withColumn("id", F.xxhash64("query"))
    stored = settle(known.withColumn("key", F.xxhash64("id")), "terms")
    exact = terms.define(stored, asked.select("query")).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("id")))
    left = settle(asked.join(exact.select("query").distinct(), "query", "left_anti"), "asked")
    vectors = models.embed(stored.select(F.col("key").alias("id"), "document"), "document", embedder).select("id", "vec")
    near = similarity.top_k(models.embed(left, "query", embedder).select("id", "vec"), vectors, top_k)
    near = near.select(F.col("query_id").alias("_q"), "rank", F.col("id").alias("key")).join(stored, "key").join(left.select(F.col("id").alias("_q"), "query"), "_q")
    shown = X.definition_text(F.col("term"), F.col("abbreviation"), F.col("definition"), F.col("source_file"), F.col("page_number"), F.col("section_heading"))
    both = exact.select("query", "rank", shown.alias("_t")).unionByName(near.select("query", "rank", shown.alias("_t")))
    made = both.groupBy("query").agg(joined("rank", "_t", "\n---\n").alias("result"))
    return asked.select("query").join(made, "query", "left").withColumn("result", F.coalesce("result", F.format_string("No definition found for '%s'.", "query")))


def evaluate_citation(rows: DataFrame, embedder: models.Embedder | None = None, yes: float = 0.5, partial: float = 0.25) -> DataFrame:
    """Rows (requirement, passage) with a verdict by the similarity of both texts."""
    both = models.embed(models.embed(rows, "requirement", embedder, "_r"), "passage", embedder, "_p")
    s = F.round(similarity.dot(F.col("_r"), F.col("_p")), 5)
    verdict = F.when(s >= yes, "yes").when(s >= partial, "partial").otherwise("no")
    return both.withColumn("similarity", s).withColumn("verdict", verdict).drop("_r", "_p")


def extract_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(derived.lines(spark, sf_dir))


def section_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(derived.lines(spark, sf_dir))


RENDERED = manual_queries.QUERIES["render_section"][1].split("SELECT doc_id, section_no, ")[-1].split(" AS rendered")[0]
CONTEXT = manual_queries.QUERIES["ref_context"][1].split("SELECT doc_id, section_no, ")[-1].split(" AS context")[0]
CONTEXTS_SQL = f"""{manual_queries.WITH}, {manual_queries.REFS_SQL}, cx AS (SELECT doc_id, section_no, {CONTEXT} AS context FROM resolved GROUP BY ALL)
SELECT doc_id, section_no, {RENDERED} || coalesce(chr(10) || context, '') AS text FROM merged LEFT JOIN cx USING (doc_id, section_no)"""
QUERIES = {"extract_requirements": (extract_requirements, None), "section_contexts": (section_contexts, CONTEXTS_SQL)}
