"""Marked text as a typed line table, and sections assembled from it.

Lines carry (doc_id, line_no, line).  Order is given by line_no alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

SECTION_MAX_CHARS = 5000
CONTINUED = " (cont.)"
# Marks of a page and of a heading with its level and text; each is a whole line.
PAGE_MARK, HEADING_MARK = r"^\[PAGE (\d+)\]$", r"^\[HEADING (\d+)\] (.+)$"


def to_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, line_no, line), from 1."""
    return docs.select("doc_id", F.posexplode(F.split("text", X.BREAK, -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def to_text(lines: DataFrame) -> DataFrame:
    """The inverse of to_lines()."""
    return lines.groupBy("doc_id").agg(joined("line_no", "line", "\n").alias("text"))


def joined(order: str, value: str, sep: str) -> Column:
    """Ordered string aggregate: the values by `order`, with sep between."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), sep)


def typed(lines: DataFrame) -> DataFrame:
    """Add kind (page, heading, table_start, table_end, table, body), level, page and heading to each line; W1.

    `closes` tells an end that has an open table.

    A line is inside a table from [TABLE] to the next [/TABLE]; page and heading
    marks count inside tables too, as the page mark is looked at first.
    """
    line = F.col("line")
    page = F.nullif(F.regexp_extract(line, PAGE_MARK, 1), F.lit("")).cast("int")
    level = F.nullif(F.regexp_extract(line, HEADING_MARK, 1), F.lit("")).cast("int")
    seq = Window.partitionBy("doc_id").orderBy("line_no")
    upto = seq.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(X.strip(line) == "[TABLE]", 1).when(X.strip(line) == "[/TABLE]", 0)
    df = lines.withColumn("_page", page).withColumn("_mark", F.when(page.isNull(), mark)).withColumn("_inside", F.coalesce(F.last("_mark", ignorenulls=True).over(upto), F.lit(0)))
    before = F.coalesce(F.last("_mark", ignorenulls=True).over(seq.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("closes", (F.col("_mark") == 0) & (before == 1))
    kind = (
        F.when(F.col("_page").isNotNull(), "page")
        .when(mark == 1, "table_start")
        .when(mark == 0, "table_end")
        .when(F.col("_inside") == 1, "table")
        .when(level.isNotNull(), "heading")
        .otherwise("body")
    )
    df = df.withColumn("kind", kind).withColumn("level", F.when(F.col("kind") == "heading", level))
    df = df.withColumn("page", F.coalesce(F.last("_page", ignorenulls=True).over(upto), F.lit(1)))
    df = df.withColumn("heading", F.when(F.col("kind") == "heading", X.strip(F.regexp_extract(line, HEADING_MARK, 2))))
    return df.drop("_page", "_inside", "_mark")


def segment(lines: DataFrame) -> DataFrame:
    """Sections (doc_id, section_no, heading, level, text, tables, page_start, page_end, char_count).

    Section 0 is the preamble; each heading opens the next one.  Windows and
    aggregates all work on doc_id's partitions: one shuffle in all.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    seq = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = typed(lines).withColumn("_table", F.sum((F.col("kind") == "table_start").cast("int")).over(seq))
    df = df.withColumn("section_no", F.sum((F.col("kind") == "heading").cast("int")).over(seq).cast("int"))
    # a text that begins with a heading still has an empty preamble
    first = (F.row_number().over(order) == 1) & (F.col("kind") == "heading")
    df = df.withColumn("_first", first).withColumn("_own", F.explode(F.when(F.col("_first"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))))
    own = F.col("_own")
    opens = own & (F.col("kind") == "heading")
    row = F.struct("line_no", F.when(own, F.col("kind")).otherwise("none").alias("kind"), "closes", "_table", "line")
    groups = df.groupBy("doc_id", F.when(own, F.col("section_no")).otherwise(0).alias("section_no")).agg(
        F.sort_array(F.collect_list(row)).alias("_l"), F.max(F.when(opens, F.col("heading"))).alias("_h"), F.max(F.when(opens, F.col("level"))).alias("_v"),
        F.min("page").alias("_p"), F.max(F.when(own, F.col("page")).otherwise(1)).alias("page_end"))
    of_kind = lambda k: F.filter("_l", lambda x: x["kind"] == k)
    text = X.strip(F.array_join(F.transform(of_kind("body"), lambda x: x["line"]), "\n"))
    inside = lambda e: F.array_join(F.transform(F.filter(of_kind("table"), lambda x: x["_table"] == e["_table"]), lambda x: x["line"]), "\n")
    tables = F.transform(of_kind("table_end"), lambda e: F.when(e["closes"], inside(e)).otherwise(""))
    out = groups.select("doc_id", "section_no", F.coalesce("_h", F.lit("Preamble")).alias("heading"), F.coalesce("_v", F.lit(1)).alias("level"), text.alias("text"), tables.alias("tables"), F.when(F.col("_v").isNotNull(), F.col("_p")).otherwise(1).alias("page_start"), "page_end")
    return out.withColumn("char_count", F.length("text"))


def merge_empty(sections: DataFrame) -> DataFrame:
    """A section without text and tables goes, giving its first page to the next one; a closing one stays.

    Of several in a row the last gives its page.
    """
    seq = Window.partitionBy("doc_id").orderBy("section_no")
    empty = (F.col("text") == "") & (F.size("tables") == 0)
    df = sections.withColumn("_before", F.lag(F.when(empty, F.col("page_start"))).over(seq)).withColumn("_last", F.lead("section_no").over(seq).isNull())
    df = df.where(~empty | F.col("_last")).withColumn("page_start", F.when(empty, F.col("page_start")).otherwise(F.coalesce("_before", "page_start")))
    return df.drop("_before", "_last").withColumn("section_no", (F.row_number().over(seq) - 1).cast("int"))


def sub_split(sections: DataFrame, limit: int = SECTION_MAX_CHARS) -> DataFrame:
    """Cut sections of over `limit` characters at paragraphs; tables stay on the first piece."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))

    def step(s: Column, p: Column) -> Column:
        sep = F.when(F.size(s["cur"]) > 0, 2).otherwise(0)
        full = (s["n"] + sep + F.length(p) > limit) & (F.size(s["cur"]) > 0)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]).alias("done"),
            F.when(full, F.array(p)).otherwise(F.concat(s["cur"], F.array(p))).alias("cur"),
            F.when(full, F.length(p)).otherwise(s["n"] + sep + F.length(p)).alias("n"),
        )

    pieces = F.aggregate(X.paragraphs(F.col("text")), start, step, lambda s: F.transform(F.concat(s["done"], F.array(s["cur"])), lambda x: F.array_join(x, "\n\n")))
    df = sections.withColumn("_pieces", F.when(F.col("char_count") > limit, pieces).otherwise(F.array("text")))
    df = df.select("*", F.posexplode("_pieces").alias("_k", "_piece"))
    out = df.select(
        "doc_id", "section_no", F.col("_k").alias("piece_no"), F.concat("heading", F.when(F.col("_k") > 0, CONTINUED).otherwise("")).alias("heading"), "level", F.col("_piece").alias("text"),
        F.when(F.col("_k") == 0, F.col("tables")).otherwise(F.array().cast("array<string>")).alias("tables"), "page_start", "page_end", F.length("_piece").alias("char_count"))
    return out


def obligation_text(text: Column, tables: Column) -> Column:
    """Body and tables as the obligation test and the cache key see them."""
    return F.concat(text, F.array_join(tables, "\n"))


def flag_obligations(sections: DataFrame) -> DataFrame:
    """Kept tells sections with tables or an obligation phrase."""
    return sections.withColumn("kept", (F.size("tables") > 0) | X.has_obligation(obligation_text(F.col("text"), F.col("tables"))))


def split_large(sections: DataFrame, max_chars: int = 800, max_count: int = 8) -> DataFrame:
    """Large tells sections that go alone; batching is off when either limit allows no batch."""
    if max_chars <= 0 or max_count <= 1:
        return sections.withColumn("large", F.lit(True))
    return sections.withColumn("large", (F.col("char_count") >= max_chars) | (F.size("tables") > 0))


def batch_small(sections: DataFrame, max_chars: int = 800, max_count: int = 8) -> DataFrame:
    """Number the batches of each document's small sections, in order.

    A batch closes at max_count sections or when the next would take it over
    max_chars * max_count characters.
    """
    small = split_large(sections, max_chars, max_count).where("NOT large")
    rows = small.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("section_no", "char_count"))).alias("rows"))
    start = F.struct(F.array().cast("array<struct<section_no:int,batch_no:int>>").alias("out"), F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).alias("chars"))

    def step(s: Column, r: Column) -> Column:
        full = (s["n"] > 0) & ((s["n"] >= max_count) | (s["chars"] + r["char_count"] > max_chars * max_count))
        batch = s["batch"] + full.cast("int")
        row = F.struct(r["section_no"].alias("section_no"), batch.alias("batch_no"))
        return F.struct(F.concat(s["out"], F.array(row)).alias("out"), batch.alias("batch"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"), F.when(full, r["char_count"]).otherwise(s["chars"] + r["char_count"]).alias("chars"))

    return rows.select("doc_id", F.inline(F.aggregate("rows", start, step)["out"]))
