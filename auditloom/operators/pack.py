"""A5: greedy packing of ordered paragraphs into overlapping chunks, folded inside each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

CHUNK_SIZE, CHUNK_OVERLAP = 300, 75


def units(pages: Column, size: int, split=X.paragraphs) -> Column:
    """Packing units of pages array<struct<page_number, text>>: whole paragraphs, or sentences of those over size.

    `opens` marks the first sentence of an oversize paragraph, `closes` the last.
    """

    def of_paragraph(page: Column, p: Column) -> Column:
        cut = X.sentences(p)
        whole = F.struct(p.alias("text"), page.alias("page"), F.lit(False).alias("sentence"), F.lit(False).alias("opens"), F.lit(False).alias("closes"))
        parts = X.let(cut, lambda c: F.transform(c, lambda s, i: F.struct(s.alias("text"), page.alias("page"), F.lit(True).alias("sentence"), (i == 0).alias("opens"), (i == F.size(c) - 1).alias("closes"))))
        return F.when(F.length(p) > size, parts).otherwise(F.array(whole))

    return F.flatten(F.flatten(F.transform(pages, lambda g: F.transform(split(g["text"]), lambda p: of_paragraph(g["page_number"], p)))))


def pack(unit_list: Column, size: int, overlap: int) -> Column:
    """Fold units into chunks array<struct<text, page_number>>.

    The budget holds for a chunk's own text; the overlap, the last characters of
    the chunk emitted before, comes on top.
    """
    start = F.struct(F.array().cast("array<struct<text:string,page_number:int>>").alias("out"), F.array().cast("array<string>").alias("buf"), F.lit(0).alias("n"), F.lit(0).alias("page"), F.lit("").alias("tail"))

    def emitted(s: Column, sep: str) -> Column:
        """The state after its buffer, if any, was emitted."""
        body = X.strip(F.array_join(s["buf"], sep))
        made = F.when(s["tail"] != "", X.strip(F.concat(s["tail"], F.lit("\n\n"), F.array_join(s["buf"], sep)))).otherwise(body)

        def after(text: Column) -> Column:
            filled = (F.size(s["buf"]) > 0) & (text != "")
            row = F.struct(text.alias("text"), s["page"].alias("page_number"))
            return F.struct(
                F.when(filled, F.concat(s["out"], F.array(row))).otherwise(s["out"]).alias("out"), F.array().cast("array<string>").alias("buf"), F.lit(0).alias("n"), s["page"].alias("page"),
                F.when(filled, X.tail_of(text, overlap)).otherwise(s["tail"]).alias("tail"))

        return X.let(made, after)

    def added(s: Column, u: Column, gap: int) -> Column:
        fresh = F.size(s["buf"]) == 0
        return F.struct(s["out"].alias("out"), F.concat(s["buf"], F.array(u["text"])).alias("buf"), (s["n"] + F.when(fresh, 0).otherwise(gap) + F.length(u["text"])).alias("n"), F.when(fresh, u["page"]).otherwise(s["page"]).alias("page"), s["tail"].alias("tail"))

    def fits(s: Column, u: Column, gap: int) -> Column:
        return s["n"] + F.when(F.size(s["buf"]) > 0, gap).otherwise(0) + F.length(u["text"]) <= size

    def sentence(s: Column, u: Column) -> Column:
        def from_clean(c: Column) -> Column:
            def then(a: Column) -> Column:
                return F.when(u["closes"], emitted(a, "\n\n")).otherwise(a)

            return F.when(fits(c, u, 1), X.let(added(c, u, 1), then)).otherwise(X.let(emitted(c, " "), lambda e: X.let(added(e, u, 1), then)))

        return F.when(u["opens"], X.let(emitted(s, "\n\n"), from_clean)).otherwise(from_clean(s))

    def paragraph(s: Column, u: Column) -> Column:
        return F.when(fits(s, u, 2), added(s, u, 2)).otherwise(X.let(emitted(s, "\n\n"), lambda e: added(e, u, 2)))

    return F.aggregate(unit_list, start, lambda s, u: F.when(u["sentence"], sentence(s, u)).otherwise(paragraph(s, u)), lambda s: X.let(emitted(s, "\n\n"), lambda e: e["out"]))


def chunk(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, split=X.paragraphs) -> DataFrame:
    """docs (source_file, pages) to chunks (text, source_file, folder, page_number, chunk_index)."""
    packed = docs.select("source_file", F.posexplode(pack(units(F.col("pages"), size, split), size, overlap)).alias("chunk_index", "c"))
    return packed.select(F.col("c.text").alias("text"), "source_file", X.folder_of(F.col("source_file")).alias("folder"), F.col("c.page_number").alias("page_number"), "chunk_index")


def gather_pages(pages: DataFrame) -> DataFrame:
    """(source_file, page_number, text) rows to one row of ordered pages per file."""
    return pages.groupBy("source_file").agg(F.sort_array(F.collect_list(F.struct("page_number", "text"))).alias("pages"))


def chunk_id(source_file: Column, index: Column) -> Column:
    return F.concat(source_file, F.lit("::"), index.cast("string"))
