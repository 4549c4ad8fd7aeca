"""The derived regulatory corpus: one marked document per supplier, the same text in Spark and in DuckDB.

Lines are templates with the supplier's key and nation filled in; a template
belongs to the suppliers whose key has its remainder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import ROW_BYTES, parts

REPEATED = "The plan will maintain records and implement controls in every unit. "
REPEATS = 32

#: (modulus, remainder, line)
MANUAL = [
    (1, 0, "Text before the first heading of plan {s}."),
    (1, 0, "[PAGE 1]"),
    (1, 0, "Plan Manual {s}"),
    (1, 0, "[HEADING 1] Section 1 {n}"),
    (1, 0, "The plan must submit reports to {n} within 30 business days. Staff shall keep records!"),
    (1, 0, "Enhanced Care Management (ECM) serves members. See Section 2 for details."),
    (1, 0, ""),
    (1, 0, "Random Words (QQQ) are no acronym, per Appendix B, and see Section 1 as well."),
    (2, 0, "Managed Care Plan (MCP) and Enhanced Care Management (ECM) come again."),
    (1, 0, "Population Health Management"),
    (1, 0, "(PHM) stands on a line of its own."),
    (1, 0, "Page 1 of 4"),
    (1, 0, "[PAGE 2]"),
    (1, 0, "Plan Manual {s}"),
    (1, 0, "[HEADING 2] Section 2 Reporting"),
    (1, 0, "Reports are due quarterly. Requirements of Section III.A apply, as defined in Section III.A."),
    (1, 0, "[TABLE]"),
    (1, 0, "| Requirement | Owner | Deadline | Evidence |"),
    (1, 0, "| keep file {s} | Compliance | 30 days | log |"),
    (1, 0, "| notify member {s} |  | monthly | letter |"),
    (1, 0, "| report outcome | Quality | annually | report |"),
    (1, 0, "[/TABLE]"),
    (1, 0, "Page 2 of 4"),
    (1, 0, "[PAGE 3]"),
    (1, 0, "Plan Manual {s}"),
    (1, 0, "[HEADING 3] III.A Credentialing"),
    (1, 0, "Providers may not start before approval. They are expected to comply with 42 CFR § 438.210(b)."),
    (3, 1, "Plans should ensure that Annex C, Exhibit 7 and Appendix B agree."),
    (1, 0, "[HEADING 1] "),
    (4, 1, "[PAGE 9] is no mark of a page for plan {s}"),
    (3, 2, "[HEADING 1] Gone Before"),
    (1, 0, "[HEADING 2] Empty {s}"),
    (5, 1, "[PAGE 4]"),
    (1, 0, "[HEADING 2] Quiet Words"),
    (1, 0, "Nothing is asked for here. See Section 99."),
    (1, 0, "[PAGE 4]"),
    (1, 0, "[HEADING 1] Appendix B: Definitions"),
    (1, 0, "Population of Focus: A group of members served by plan {s}."),
    (1, 0, "- Care Plan: The written plan for one member."),
    (1, 0, "[TABLE]"),
    (1, 0, "| Term | Definition |"),
    (1, 0, "| Encounter {s} | A visit between member and provider |"),
    (1, 0, "| Short | tiny |"),
    (1, 0, "| care plan | A later row of the same term |"),
    (1, 0, "[/TABLE]"),
    (1, 0, "Page 4 of 4"),
    (1, 0, "[HEADING 2] Coverage Terms"),
    (1, 0, "[TABLE]"),
    (1, 0, "| Criteria | Meaning |"),
    (1, 0, "| Outreach | Contact made to engage a member |"),
    (1, 0, "| Encounter {s} | Second meaning of the encounter |"),
    (1, 0, "[/TABLE]"),
    (1, 0, "[HEADING 3] 4.2 Review Questions"),
    (1, 0, "1. Does the P&P state that plan {s} must respond? (Reference: APL 25-001, page 2)"),
    (2, 1, "2. Does the P&P describe outreach (P&P may include examples) (Reference: APL 25-002, page 3-4 (b))"),
    (5, 0, "[HEADING 2] Long Matters"),
    (5, 0, "A {rep}"),
    (5, 0, ""),
    (5, 0, "B {rep}"),
    (5, 0, ""),
    (5, 0, "C {rep}"),
    (1, 0, "[HEADING 2] Closing"),
]

LISTS = [
    (2, 0, "Words before the list of {n}"),
    (2, 0, "1. First item of {s}"),
    (2, 0, "   a. Sub item"),
    (2, 0, "   and its second line"),
    (2, 0, "      i. Deep item"),
    (2, 0, "      (ii) Deep again"),
    (2, 0, ""),
    (2, 0, "   b) Another sub item"),
    (2, 0, "2. Second item"),
    (2, 1, "1. Alpha {s}"),
    (2, 1, "a. Beta"),
    (2, 1, "i. Gamma"),
    (2, 1, "ii. Gamma again"),
    (2, 1, "A. Delta"),
    (2, 1, "b. Epsilon"),
    (2, 1, "2. Zeta of {n}"),
    (6, 1, "      A. first deeper line of a flat list"),
    (8, 2, "  \t(iv) behind a tab stop"),
]


def lines(spark: SparkSession, sf_dir: str, templates: list[tuple[int, int, str]] = MANUAL) -> DataFrame:
    """(doc_id, line_no, line), by documents in partitions of bounded size, so that what works by document needs no other shuffle."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    owner = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("doc_id"), "n_name")
    n = parts(spark, 2 * ROW_BYTES * len(templates) * read("supplier").count())
    owner = owner.repartition(n, "doc_id")
    rows = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(r).alias("r"), F.lit(t).alias("t")) for m, r, t in templates))
    df = owner.select("doc_id", "n_name", F.posexplode(rows).alias("line_no", "x")).where("doc_id % x.m = x.r")
    text = F.replace(F.replace(F.replace(F.col("x.t"), F.lit("{s}"), F.col("doc_id").cast("string")), F.lit("{n}"), F.col("n_name")), F.lit("{rep}"), F.repeat(F.lit(REPEATED), F.lit(REPEATS)))
    return df.select("doc_id", (F.col("line_no") + 1).alias("line_no"), text.alias("line"))


def lines_sql(templates: list[tuple[int, int, str]] = MANUAL) -> str:
    values = ", ".join(f"({i}, {m}, {r}, '{t}')" for i, (m, r, t) in enumerate(templates, 1))
    return f"""SELECT s_suppkey AS doc_id, x.i AS line_no, replace(replace(replace(x.t, '{{s}}', s_suppkey::varchar), '{{n}}', n_name), '{{rep}}', repeat('{REPEATED}', {REPEATS})) AS line
FROM supplier JOIN nation ON s_nationkey = n_nationkey, (VALUES {values}) x(i, m, r, t) WHERE s_suppkey % x.m = x.r"""


#: CTEs for DuckDB: the typed lines, the sections, and those after the forward merge.
SECTIONS_SQL = rf"""
lines AS ({lines_sql()}),
marked AS (SELECT *, TRY_CAST(nullif(regexp_extract(line, '^\[PAGE (\d+)\]$', 1), '') AS int) AS pg,
  CASE trim(line) WHEN '[TABLE]' THEN 1 WHEN '[/TABLE]' THEN 0 END AS mk,
  TRY_CAST(nullif(regexp_extract(line, '^\[HEADING (\d+)\] .', 1), '') AS int) AS lv FROM lines),
inside AS (SELECT *, coalesce(last_value(mk IGNORE NULLS) OVER w, 0) AS ins, coalesce(last_value(pg IGNORE NULLS) OVER w, 1) AS page FROM marked
  WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
kinds AS (SELECT *, CASE WHEN pg IS NOT NULL THEN 'page' WHEN mk = 1 THEN 'table_start' WHEN mk = 0 THEN 'table_end' WHEN ins = 1 THEN 'table' WHEN lv IS NOT NULL THEN 'heading' ELSE 'body' END AS kind FROM inside),
numbered AS (SELECT *, count(*) FILTER (kind = 'heading') OVER w AS section_no, count(*) FILTER (kind = 'table_start') OVER w AS tno FROM kinds
  WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
tab AS (SELECT doc_id, section_no, tno, string_agg(line, chr(10) ORDER BY line_no) AS t FROM numbered WHERE kind = 'table' GROUP BY ALL),
tabs AS (SELECT doc_id, section_no, list(t ORDER BY tno) AS tables FROM tab GROUP BY ALL),
raw AS (SELECT doc_id, section_no, coalesce(max(trim(regexp_extract(line, '^\[HEADING \d+\] (.+)$', 1))) FILTER (kind = 'heading'), 'Preamble') AS heading, coalesce(max(lv) FILTER (kind = 'heading'), 1) AS level,
  coalesce(trim(string_agg(line, chr(10) ORDER BY line_no) FILTER (kind = 'body'), ' ' || chr(10)), '') AS text, CASE WHEN bool_or(kind = 'heading') THEN min(page) ELSE 1 END AS page_start, max(page) AS page_end FROM numbered GROUP BY ALL),
sections AS (SELECT raw.doc_id, raw.section_no, heading, level, text, coalesce(tables, []) AS tables, page_start, page_end, length(text) AS char_count FROM raw LEFT JOIN tabs USING (doc_id, section_no)),
looked AS (SELECT *, text = '' AND len(tables) = 0 AS bare, lead(section_no) OVER w AS nxt FROM sections WINDOW w AS (PARTITION BY doc_id ORDER BY section_no)),
given AS (SELECT *, lag(CASE WHEN bare THEN page_start END) OVER (PARTITION BY doc_id ORDER BY section_no) AS bp FROM looked),
merged AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_no) - 1 AS section_no, heading, level, text, tables,
  CASE WHEN bare OR bp IS NULL THEN page_start ELSE bp END AS page_start, page_end, char_count FROM given WHERE NOT bare OR nxt IS NULL)
"""
