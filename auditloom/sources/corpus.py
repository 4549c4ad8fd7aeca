"""Reading documents: PDF folders, line tables as pages, HTML blocks."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.lines import joined

LINES_PER_PAGE = 40
#: The error of a file that can be read but holds no text.
NO_TEXT = "no text"


def text_pages(docs: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """S1, P1 on text rows (doc_id, text): (doc_id, page_number, text), pages without text left out.

    Pages are cut inside the row: no shuffle.
    """
    lines = F.split("text", "\n", -1)
    n_pages = F.ceil(F.size(lines) / lines_per_page).cast("int")
    pages = X.let(lines, lambda x: F.transform(F.sequence(F.lit(1), n_pages), lambda k: F.struct(k.alias("page_number"), F.array_join(F.slice(x, (k - 1) * lines_per_page + 1, F.lit(lines_per_page)), "\n").alias("text"))))
    return docs.where("text IS NOT NULL").select("doc_id", F.inline(pages)).where(~X.blank(F.col("text")))


def corpus_files(spark: SparkSession, root: str, suffix: str = ".pdf") -> DataFrame:
    """(folder, file, path, length, sha256, content) of root/*/*suffix; a missing root raises.

    Content is read only where it is selected.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file"), "path", "length", F.sha2("content", 256).alias("sha256"), "content")


def plain_text(content: bytes) -> list[str]:
    """The default page reader: UTF-8 text, pages set apart by form feeds."""
    return content.decode("utf-8").split("\f")


def pdf_text(content: bytes) -> list[str]:
    """Page texts of a PDF, where a reader library is installed."""
    if not importlib.util.find_spec("pypdf"):
        raise RuntimeError("reading PDF files needs pypdf")
    import io

    import pypdf

    return [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]


def parse_files(files: DataFrame, reader: Callable[[bytes], list[str]] = plain_text) -> DataFrame:
    """(source_file, page_number, text, error): rows of pages, or one row with the error of a file.

    A file that cannot be read, or has no text, does not fail the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for folder, file, content in zip(*(batch.column(c).to_pylist() for c in ("folder", "file", "content")), strict=True):
                name = f"{folder}/{file}"
                try:
                    pages = [(name, i, t.strip(), None) for i, t in enumerate(reader(content), 1) if t.strip()]
                    rows += pages or [(name, None, None, NO_TEXT)]
                except Exception as e:  # any reader's error belongs to its file
                    rows.append((name, None, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["source_file", "page_number", "text", "error"])

    return files.select("folder", "file", "content").mapInArrow(run, "source_file string, page_number int, text string, error string")


def ingest_stats(parsed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files read, chunks, and the errors."""
    files = parsed.agg(F.countDistinct(F.when(F.col("error").isNull(), F.col("source_file"))).alias("files"), F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.concat_ws(": ", "source_file", "error")))).alias("errors"))
    return files.withColumn("chunks", chunks.agg(F.count("*")).scalar())


def html_blocks(pages: DataFrame) -> DataFrame:
    """S2 on HTML: (page_id, block_no, tag, text) of headings, paragraphs and list items in page order."""
    tag = r"(?s)<(h[1-6]|p|li)\b[^>]*>(.*?)(?=<(?:h[1-6]|p|li|/article|/ul|/h[1-6]|/p|/li)\b)"
    found = F.arrays_zip(F.expr(f"regexp_extract_all(html, r'{tag}', 1)").alias("tag"), F.expr(f"regexp_extract_all(html, r'{tag}', 2)").alias("text"))
    rows = pages.select("page_id", F.posexplode(found).alias("block_no", "b"))
    return rows.select("page_id", "block_no", F.col("b.tag").alias("tag"), X.strip(F.regexp_replace("b.text", "<[^>]*>", "")).alias("text"))


def to_marked_text(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, page_number, place, level, text, is_table) to marked lines (doc_id, text)."""
    body = F.when(F.col("is_table"), F.concat(F.lit("[TABLE]\n"), F.col("text"), F.lit("\n[/TABLE]"))).when(F.col("level").isNotNull(), F.format_string("[HEADING %d] %s", "level", "text")).otherwise(F.col("text"))
    pages = blocks.withColumn("_b", body).groupBy("doc_id", "page_number").agg(joined("place", "_b", "\n").alias("_p")).withColumn("_p", F.concat(F.format_string("[PAGE %d]\n", "page_number"), "_p"))
    return pages.groupBy("doc_id").agg(joined("page_number", "_p", "\n").alias("text"))
