"""Tables, term definitions and their lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import settle
from .lines import to_text

MIN_DEFINITION, MAX_TERM_WORDS, MAX_ACRONYM = 10, 8, 10
GLOSSARY_PRIORITY, INLINE_PRIORITY, TABLE_PRIORITY = 1, 2, 3


def _first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def pipe_tables(sections: DataFrame) -> DataFrame:
    """one row per table line after the header: doc_id, section_no, table_no, row_no, header, cells."""
    df = sections.select("doc_id", "section_no", "heading", "page_start", F.posexplode("tables").alias("table_no", "table")).withColumn("header", X.table_header(F.col("table")))
    df = df.select("*", F.posexplode(X.table_lines(F.col("table"))).alias("row_no", "_line")).where("row_no > 0").withColumn("cells", X.table_cells(F.col("_line"))).where(F.size("cells") > 0)
    return df.drop("_line", "table")


def _columns(rows: DataFrame, term_words: tuple[str, ...], definition_words: tuple[str, ...]) -> DataFrame:
    return rows.withColumn("tc", X.column_index(F.col("header"), term_words, 0)).withColumn("dc", X.column_index(F.col("header"), definition_words, 1))


def _table_terms(rows: DataFrame) -> DataFrame:
    df = rows.where(F.size("cells") > F.greatest("tc", "dc")).withColumn("term", F.get("cells", F.col("tc"))).withColumn("definition", F.get("cells", F.col("dc")))
    return df.where(f"term <> '' AND length(definition) >= {MIN_DEFINITION}")


def glossary_terms(sections: DataFrame) -> DataFrame:
    """terms of glossary sections, tables before lines, the first of each term."""
    glossary = sections.where(X.is_glossary_heading(F.col("heading")))
    rows = _columns(pipe_tables(glossary).where(F.size("header") >= 2), ("term", "criteria", "name", "abbr"), ("definition", "description", "meaning", "criteria"))
    rows = rows.withColumn("dc", F.when(F.col("tc") == F.col("dc"), F.when(F.col("tc") == 0, 1).otherwise(0)).otherwise(F.col("dc")))
    tables = _table_terms(rows).select("doc_id", "section_no", F.lit(0).alias("kind"), F.col("table_no").alias("a"), F.col("row_no").alias("b"), "term", "definition", "page_start", "heading")
    pattern = X.wide(X.GLOSSARY_LINE)
    matched = F.arrays_zip(F.expr(f"regexp_extract_all(text, r'{pattern}', 1)").alias("t"), F.expr(f"regexp_extract_all(text, r'{pattern}', 2)").alias("d"))
    lines = glossary.select("doc_id", "section_no", "page_start", "heading", F.posexplode(matched).alias("a", "m"))
    term = X.strip(F.rtrim(X.strip(F.col("m.t")), F.lit(":")))
    lines = lines.select("doc_id", "section_no", F.lit(1).alias("kind"), "a", F.lit(0).alias("b"), term.alias("term"), X.strip(F.col("m.d")).alias("definition"), "page_start", "heading")
    lines = lines.where(f"term <> '' AND length(definition) >= {MIN_DEFINITION}").where(F.size(F.split("term", rf"{X.SPACE}+")) <= MAX_TERM_WORDS)
    found = tables.unionByName(lines).withColumn("key", F.lower("term"))
    return _first(found, ["doc_id", "key"], ["section_no", "kind", "a", "b"])


def page_pieces(lines: DataFrame) -> DataFrame:
    """Texts cut before every page mark: (doc_id, piece_no, page, piece); a place has its piece's page, 1 before the first mark.

    Marks count wherever they stand in a line.
    """
    pieces = to_text(lines).select("doc_id", F.posexplode(F.split("text", r"(?=\[PAGE \d+\])")).alias("piece_no", "piece"))
    page = F.nullif(F.regexp_extract("piece", r"^\[PAGE (\d+)\]", 1), F.lit("")).cast("int")
    return pieces.select("doc_id", "piece_no", F.coalesce(page, F.lit(1)).alias("page"), "piece")


def inline_acronyms(lines: DataFrame) -> DataFrame:
    """first accepted "Phrase (ACR)" of each acronym in a document, with its page.

    The phrase and its acronym may stand on two lines, but no phrase holds a page
    mark, so pieces between marks are searched apart.
    """
    pattern = X.wide(X.INLINE_ACRONYM)
    matched = F.arrays_zip(F.expr(f"regexp_extract_all(piece, r'{pattern}', 1)").alias("p"), F.expr(f"regexp_extract_all(piece, r'{pattern}', 2)").alias("a"))
    found = page_pieces(lines).select("doc_id", "piece_no", "page", F.posexplode(matched).alias("k", "m")).select("doc_id", "piece_no", "page", "k", X.strip(F.col("m.p")).alias("term"), X.strip(F.col("m.a")).alias("abbreviation"))
    found = found.where((F.length("abbreviation") <= MAX_ACRONYM) & X.initials_match(F.col("term"), F.col("abbreviation"))).withColumn("abbr_key", F.upper("abbreviation"))
    return _first(found, ["doc_id", "abbr_key"], ["piece_no", "k"]).withColumn("definition", F.format_string("%s (%s)", "term", "abbreviation"))


def definition_tables(sections: DataFrame) -> DataFrame:
    """Terms of definition tables outside glossaries, the first of each term."""
    rows = pipe_tables(sections.where(~X.is_glossary_heading(F.col("heading")))).where(X.is_definition_table(F.col("header")))
    rows = _columns(rows, ("term", "criteria", "name"), ("definition", "description", "meaning")).where("tc <> dc")
    return _first(_table_terms(rows).withColumn("key", F.lower("term")), ["doc_id", "key"], ["section_no", "table_no", "row_no"])


def all_terms(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """Glossary, inline and table terms; an earlier source keeps a later one's term out.

    Glossary terms have no acronym of their own, so one ranking by source per
    term gives the same rows as checking each source against those before it.
    """
    none = F.lit(None).cast("string")
    sections = settle(sections, "sections")  # read by two of the sources

    def rows(df: DataFrame, priority: int, name: str, abbreviation: Column, page: str, heading: Column, order: Column) -> DataFrame:
        return df.select("doc_id", F.lit(priority).alias("priority"), F.lower("term").alias("key"), order.alias("_o"), "term", abbreviation.alias("abbreviation"), "definition", F.col(page).alias("page_number"), heading.alias("section_heading"), F.lit(name).alias("source"))

    found = (
        rows(glossary_terms(sections), GLOSSARY_PRIORITY, "glossary", none, "page_start", F.col("heading"), F.lit(0))
        .unionByName(rows(inline_acronyms(lines), INLINE_PRIORITY, "inline_acronym", F.col("abbreviation"), "page", none, F.col("piece_no") * (1 << 31) + F.col("k")))
        .unionByName(rows(definition_tables(sections), TABLE_PRIORITY, "definition_table", none, "page_start", F.col("heading"), F.lit(0)))
    )
    return _first(found, ["doc_id", "key"], ["priority", "_o"]).drop("_o", "key")


def term_rows(terms: DataFrame) -> DataFrame:
    """Id and document of every term, as they are stored."""
    name = F.coalesce("abbreviation", "term")
    text = F.when(F.col("abbreviation").isNotNull(), F.format_string("%s (%s): %s", "term", "abbreviation", "definition")).otherwise(F.format_string("%s: %s", "term", "definition"))
    return terms.withColumn("id", F.concat(F.col("source_file"), F.lit("::"), name)).withColumn("document", text)


def define(terms: DataFrame, queries: DataFrame) -> DataFrame:
    """Terms whose acronym is the query, as it is or upper-cased, or whose term is the query.

    One equi-join per branch rather than a disjunctive condition.
    """
    asked = queries.select("query").distinct()
    branches = [
        asked.join(terms, F.upper("query") == F.col("abbreviation")),
        asked.join(terms, F.col("query") == F.col("abbreviation")),
        asked.join(terms, F.col("query") == F.col("term")),
    ]
    return branches[0].union(branches[1]).union(branches[2]).distinct()


# Header words of each requirement field.
REQUIREMENT_FIELDS = {"tx": ("requirement", "description", "obligation", "control"), "ac": ("owner", "responsible", "party", "actor", "role"), "tf": ("deadline", "frequency", "timeframe", "period"), "ev": ("evidence", "documentation", "artifact")}


def requirement_rows(sections: DataFrame) -> DataFrame:
    """requirements from tables that name a requirement column; one row per table line."""
    df = pipe_tables(sections)
    for name, words in REQUIREMENT_FIELDS.items():
        df = df.withColumn(name, X.column_index(F.col("header"), words, -1))
    df = df.where((F.col("tx") >= 0) & (F.size("cells") > F.col("tx"))).withColumn("exact_quote", F.get("cells", F.col("tx")))
    pick: dict[str, Column] = {n: F.when(F.col(c) >= 0, F.get("cells", F.col(c))) for n, c in (("actor", "ac"), ("timeframe", "tf"), ("evidence_needed", "ev"))}
    return df.select("doc_id", "section_no", "table_no", "row_no", F.format_string("Does the P&P state that %s?", "exact_quote").alias("text"), "exact_quote", F.format_string("%s, page %d", "heading", "page_start").alias("reference"), *(c.alias(n) for n, c in pick.items()), F.col("heading").alias("section_heading"))


def unmapped_tables(sections: DataFrame) -> DataFrame:
    """tables without a requirement column as sections of their own, for the extractor; each line is a sentence."""
    df = sections.select("doc_id", "section_no", "heading", "page_start", F.posexplode("tables").alias("table_no", "table")).withColumn("header", X.table_header(F.col("table")))
    df = df.where((F.size("header") > 0) & (X.column_index(F.col("header"), REQUIREMENT_FIELDS["tx"], -1) < 0))
    lines = F.transform(F.slice(X.table_lines(F.col("table")), F.lit(2), F.greatest(F.size(X.table_lines(F.col("table"))) - 1, F.lit(0))), lambda line: F.concat(F.array_join(X.table_cells(line), ", "), F.lit(".")))
    return df.select("doc_id", "section_no", "table_no", "heading", F.lit(2).alias("level"), F.array_join(lines, "\n").alias("text"), F.array("table").alias("tables"), "page_start", F.col("page_start").alias("page_end"))
