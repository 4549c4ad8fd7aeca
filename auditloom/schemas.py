"""Record types, enumerations and validation predicates (quarantine instead of exceptions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def struct(spec: str) -> T.StructType:
    """A schema from "name type[ not null], …", without a running session."""
    fields = [f.split(" ", 2) for f in spec.split(", ")]
    return T.StructType([T.StructField(f[0], _TYPES[f[1]], len(f) < 3) for f in fields])


PAGES = struct("source_file string, page_number int, text string")
CHUNKS = struct("text string, source_file string, folder string, page_number int, chunk_index int")
SECTIONS = struct("doc_id long, section_no int, heading string, level int, text string, tables array<string>, page_start int, page_end int, char_count int")
REQUIREMENT = struct("id int not null, text string not null, reference string, category string")
COMPLIANCE_REQUIREMENT = struct(
    "id int not null, text string not null, reference string, category string, obligation_type string, obligation_level string, actor string, action_required string, "
    "condition string, timeframe string, evidence_needed string, risk_area string, parent_id int, exact_quote string, section_heading string"
)
TERM = struct("term string, abbreviation string, definition string, source_file string, page_number int, section_heading string, source string")
PASSAGE = struct("text string, source_file string, page_number int, relevance_score double")
EVALUATION = struct("requirement_id int, answer string, citation_text string, source_file string, page_number int, confidence double, reasoning string, needs_human_review boolean, status string, reviewer_notes string")
SESSION = struct("id string, filename string, doc_type string, created_at timestamp, status string, progress int")
EVENT = struct("event string, data string")
PROGRESS = struct("type string, step string, step_number int, total_steps int, detail string, sections_completed int, sections_total int")
LIST_ITEM = struct("doc_id long, node_no int, parent_no int, is_root boolean, level int, path string, marker string, text string")
CROSS_REFERENCE = struct("raw_text string, target_key string, ref_type string")
RESOLVED_REFERENCE = struct("raw_text string, target_key string, ref_type string, heading string, summary string")
BLOCK = struct("doc_id long, page_number int, src_no int, type int, x0 double, y0 double, x1 double, y1 double, page_height double, size double, text string")
EVAL_REPORT = struct("metric string, score double, threshold double")

# Enumerations of the data model.
ANSWERS = ("yes", "no", "partial")
EVALUATION_STATUS = ("pending", "approved", "edited", "rejected")
SESSION_STATUS = ("extracting", "reviewing", "critic", "complete")
TERM_SOURCES = ("glossary", "inline_acronym", "definition_table")
EVENTS = ("evaluation", "progress", "critic_complete", "error")


def valid_evaluation() -> Column:
    """What an evaluation has to satisfy; null counts as a violation."""
    ok = F.col("requirement_id").isNotNull() & F.col("answer").isin(*ANSWERS) & F.col("confidence").between(0.0, 1.0)
    return F.coalesce(ok & F.coalesce(F.col("status"), F.lit("pending")).isin(*EVALUATION_STATUS), F.lit(False))


def valid_requirement() -> Column:
    return F.coalesce(F.col("id").isNotNull() & F.col("text").isNotNull(), F.lit(False))


def quarantine(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy ok, and the rest."""
    return df.where(ok), df.where(~ok)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the columns of schema, cast; missing ones null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
