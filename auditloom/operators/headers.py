"""Repeated headers and footers, and layout blocks of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import settle

HEADER_ZONE, FOOTER_ZONE = 0.12, 0.12
MIN_FRACTION, MIN_PAGES = 0.55, 3
#: So many repeated signatures may be broadcast: under 100 MB.
BROADCAST_MARKS = 1_000_000


def _needed(pages):
    return F.greatest(F.lit(MIN_PAGES), F.ceil(F.lit(MIN_FRACTION) * pages))


def repeated_signatures(rows: DataFrame, doc: str = "doc_id", page: str = "page_number", text: str = "text", n_pages: DataFrame | None = None) -> DataFrame:
    """A3: (doc, signature, pages) of texts on enough of a document's pages; documents of one page have none.

    n_pages (doc, n_pages) may give the number of pages; else it is that of the rows.
    """
    counts = n_pages if n_pages is not None else rows.groupBy(doc).agg(F.countDistinct(page).alias("n_pages"))
    found = rows.withColumn("signature", X.signature(F.col(text))).where("signature <> ''").groupBy(doc, "signature").agg(F.countDistinct(page).alias("pages"))
    return found.join(counts, doc).where((F.col("n_pages") >= 2) & (F.col("pages") >= _needed(F.col("n_pages")))).select(doc, "signature", "pages")


def signature_marks(text: Column) -> Column:
    """Two 64-bit hashes of a text's signature, null for an empty one: what lines are counted and matched by."""
    return X.let(X.signature(text), lambda s: F.when(s != "", F.struct(F.xxhash64(s).alias("a"), F.xxhash64(F.lit(1), s).alias("b"))))


def with_marks(lines: DataFrame) -> DataFrame:
    """lines with the mark of each; a mark that they bring is kept."""
    return lines if "mark" in lines.columns else lines.withColumn("mark", signature_marks(F.col("line")))


def repeated_marks(lines: DataFrame, doc: str, page: str, least: int = MIN_PAGES) -> DataFrame:
    """(doc, mark) of signatures on at least `least` pages of a document; only hashes are shuffled."""
    marks = with_marks(lines).select(doc, page, "mark").where("mark IS NOT NULL").distinct()
    return marks.groupBy(doc, "mark").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)


def without_repeated(lines: DataFrame, doc: str, page: str, least: int = MIN_PAGES) -> DataFrame:
    """F45 over a corpus: lines without those of repeated signatures, which stay where they are if the repeated ones may be broadcast.

    Lines with a mark need not carry their text.
    """
    known = settle(repeated_marks(lines, doc, page, least).select(doc, "mark"), "marks")
    known = F.broadcast(known) if known.count() <= BROADCAST_MARKS else known
    return with_marks(lines).join(known, [doc, "mark"], "left_anti").drop("mark")


def zone_of(y0, y1, height):
    """header, footer or null; the header zone wins."""
    return F.when(y0 / height < HEADER_ZONE, "header").when(y1 / height > 1 - FOOTER_ZONE, "footer")


def in_zones(blocks: DataFrame) -> DataFrame:
    zoned = blocks.withColumn("zone", zone_of(F.col("y0"), F.col("y1"), F.col("page_height")))
    return zoned.where("type = 0 AND zone IS NOT NULL").withColumn("bucket", X.y_bucket(F.col("y0") / F.col("page_height")))


def page_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id").agg(F.countDistinct("page_number").alias("n_pages"))


def repeated_buckets(blocks: DataFrame) -> DataFrame:
    """A4: (doc_id, zone, bucket, pages) of heights at which enough pages have a block in the zone."""
    counts = page_counts(blocks)
    found = in_zones(blocks).groupBy("doc_id", "zone", "bucket").agg(F.countDistinct("page_number").alias("pages"))
    return found.join(counts, "doc_id").where((F.col("n_pages") >= 2) & (F.col("pages") >= _needed(F.col("n_pages")))).select("doc_id", "zone", "bucket", "pages")


def drop_headers(blocks: DataFrame) -> DataFrame:
    """Blocks without those of a repeated signature, anywhere, or at a repeated height."""
    signatures = repeated_signatures(in_zones(blocks), n_pages=page_counts(blocks)).select("doc_id", "signature")
    heights = repeated_buckets(blocks).select("doc_id", "bucket").distinct()
    df = blocks.withColumn("signature", X.signature(F.col("text"))).withColumn("bucket", X.y_bucket(F.col("y0") / F.col("page_height")))
    return df.join(signatures, ["doc_id", "signature"], "left_anti").join(heights, ["doc_id", "bucket"], "left_anti").drop("signature", "bucket")


def strip_lines(lines: DataFrame, signatures: DataFrame) -> DataFrame:
    """lines without those of a known signature; both keyed by doc_id."""
    marked = lines.withColumn("signature", X.signature(F.col("line")))
    return marked.join(signatures.select("doc_id", "signature").distinct(), ["doc_id", "signature"], "left_anti").drop("signature")


def font_sizes(blocks: DataFrame) -> DataFrame:
    """A1: characters per font size, sizes to one place."""
    return blocks.where("type = 0").groupBy("doc_id", F.bround("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("chars"), F.min(F.struct("page_number", "src_no")).alias("first_seen"))


def heading_sizes(sizes: DataFrame) -> DataFrame:
    """A2: up to three sizes over the body size by more than 0.5, largest first, numbered from 1.

    The body size is the one of most characters, the first seen of equals.
    """
    body = sizes.groupBy("doc_id").agg(F.min_by("size", F.struct(-F.col("chars"), F.col("first_seen"))).alias("body"))
    larger = sizes.join(body, "doc_id").where("size > body + 0.5")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size")))
    return larger.withColumn("level", rank).where("level <= 3").select("doc_id", "size", "level")


def heading_levels(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """F8: blocks with the first heading level whose size is within 0.5, else null.

    A document has at most three heading sizes, so they ride along as an array.
    """
    levels = sizes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("level", "size"))).alias("_sizes"))
    near = lambda s: F.abs(s["size"] - F.col("size")) <= 0.5
    return blocks.join(levels, "doc_id", "left").withColumn("level", F.when(F.col("type") == 0, F.get(F.filter("_sizes", near), F.lit(0))["level"])).drop("_sizes")


def minus_tables(blocks: DataFrame) -> DataFrame:
    """Text blocks that overlap no table rectangle of their page."""
    tables = blocks.where("type = 1").select("doc_id", "page_number", *(F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")))
    text = blocks.where("type = 0")
    box = lambda p: {c: F.col(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")}
    cond = (text.doc_id == tables.doc_id) & (text.page_number == tables.page_number) & X.overlaps(box(""), box("t_"))
    return text.join(tables, cond, "left_anti")


def page_order(blocks: DataFrame) -> DataFrame:
    """O1: place of each block on its page: by height, tables first, then as given."""
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("y0", F.desc("type"), "src_no")))
