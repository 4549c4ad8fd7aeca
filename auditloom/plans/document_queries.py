"""Queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import headers, pack, review
from ..operators.lines import to_lines
from ..sources import corpus, store
from ..sources.shared import read_table, settle

SPLIT_LINES = "unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i"
#: DuckDB: trim of all white space.
STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
PAGES_SQL = f"""
ln AS (SELECT doc_id, {SPLIT_LINES} FROM documents),
pg AS (SELECT doc_id, ((i - 1) // 40 + 1)::int AS page_number, string_agg(line, chr(10) ORDER BY i) AS text FROM ln GROUP BY ALL),
pages_ AS (SELECT * FROM pg WHERE trim(text, {STRIP}) <> '')"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def page_scan(spark, sf_dir):
    return corpus.text_pages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def route_documents(spark, sf_dir):
    return review.route(page_scan(spark, sf_dir), table(spark, sf_dir, "documents"), 1)


def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sentence_no", "sentence"))


def line_units(text: Column) -> Column:
    """Lines as paragraphs: the corpus has no blank lines."""
    return X.non_blank_parts(text, "\n+")


def paragraph_units(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(X.paragraphs(F.col("text"))).alias("n_paragraphs"), F.size(line_units(F.col("text"))).alias("n_lines"))


def _path(doc_id: str = "doc_id", source: str = "source") -> Column:
    return F.concat(F.col(source), F.lit("/"), F.col(doc_id).cast("string"), F.lit(".pdf"))


def folder_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.folder_of(_path()).alias("folder"), X.folder_of(F.col("source")).alias("bare"))


def _files(spark, sf_dir) -> DataFrame:
    """One row per document with its whole text as page 1: no shuffle before packing."""
    page = F.array(F.struct(F.lit(1).alias("page_number"), F.col("text").alias("text")))
    return table(spark, sf_dir, "documents").select(_path().alias("source_file"), page.alias("pages"))


def chunk_pack(spark, sf_dir):
    return pack.chunk(_files(spark, sf_dir), 2000, 0, line_units).select("source_file", "chunk_index", "text")


def chunk_pack_overlap(spark, sf_dir):
    return pack.chunk(_files(spark, sf_dir), pack.CHUNK_SIZE, pack.CHUNK_OVERLAP, line_units)


def chunk_stats(spark, sf_dir):
    rows = chunk_pack(spark, sf_dir).groupBy("source_file").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))
    return rows.agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"), F.sum("chars").alias("chars"))


def _recursive_chunks(size: int, overlap: int) -> str:
    """The packing fold as a recursive CTE over numbered steps."""
    strip = lambda x: f"trim({x}, {STRIP})"
    tail = f"right(e.made, {overlap})" if overlap else "''"
    return rf"""
WITH RECURSIVE paras AS (SELECT source || '/' || doc_id || '.pdf' AS f, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: {strip("x")}), lambda x: x <> '') AS ps FROM documents),
exploded AS (SELECT f, unnest(ps) AS p, generate_subscripts(ps, 1) AS pi FROM paras),
cut AS (SELECT f, pi, p, list_filter(list_transform(string_split(regexp_replace(p, '([.!?])[ \t\n\v\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: {strip("x")}), lambda x: x <> '') AS ss FROM exploded),
un AS (SELECT f, pi, 0 AS si, p AS t, false AS s, false AS o, false AS c FROM cut WHERE length(p) <= {size}
  UNION ALL SELECT f, pi, si, t, true, si = 1, si = n FROM (SELECT f, pi, unnest(ss) AS t, generate_subscripts(ss, 1) AS si, len(ss) AS n FROM cut WHERE length(p) > {size})),
ops AS (
  -- what happens to the buffer: f flushes it by blank lines or spaces (gap), a adds the unit if it fits, else flushes first
  SELECT f, pi, si * 3 AS z, 'f' AS op, '' AS t, 2 AS gap FROM un WHERE o
  UNION ALL SELECT f, pi, si * 3 + 1, 'a', t, CASE WHEN s THEN 1 ELSE 2 END FROM un
  UNION ALL SELECT f, pi, si * 3 + 2, 'f', '', 2 FROM un WHERE c
  UNION ALL SELECT DISTINCT f, 1000000000, 0, 'f', '', 2 FROM un),
steps AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY pi, z) AS k FROM ops),
run(f, k, parts, n, tail, made, idx) AS (
  SELECT DISTINCT f, 0::bigint, []::varchar[], 0::bigint, '', NULL::varchar, 0::bigint FROM steps
  UNION ALL
  SELECT e.f, e.k, CASE WHEN e.op = 'f' THEN []::varchar[] WHEN e.full THEN [e.t] ELSE list_append(e.parts, e.t) END,
    CASE WHEN e.op = 'f' THEN 0 WHEN e.full THEN length(e.t) ELSE e.n + CASE WHEN len(e.parts) > 0 THEN e.gap ELSE 0 END + length(e.t) END,
    CASE WHEN e.made IS NULL THEN e.tail ELSE {tail} END, e.made, e.idx + CASE WHEN e.made IS NULL THEN 0 ELSE 1 END
  FROM (SELECT s.f, s.k, s.op, s.t, s.gap, r.parts, r.n, r.tail, r.idx, s.op = 'a' AND r.n + CASE WHEN len(r.parts) > 0 THEN s.gap ELSE 0 END + length(s.t) > {size} AS full,
      CASE WHEN len(r.parts) > 0 AND (s.op = 'f' OR r.n + s.gap + length(s.t) > {size})
        THEN {strip(f"CASE WHEN r.tail <> '' THEN r.tail || chr(10) || chr(10) ELSE '' END || CASE WHEN s.gap = 1 THEN array_to_string(r.parts, ' ') ELSE array_to_string(r.parts, chr(10) || chr(10)) END")} END AS made
    FROM run r JOIN steps s ON s.f = r.f AND s.k = r.k + 1) e),
chunks AS (SELECT f AS source_file, (idx - 1)::int AS chunk_index, made AS text FROM run WHERE made IS NOT NULL)
"""


def signatures(spark, sf_dir):
    lines = to_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.select(X.signature(F.col("line")).alias("signature")).where("signature <> ''").groupBy("signature").agg(F.count("*").alias("n"))


def _source_lines(spark, sf_dir) -> DataFrame:
    """Sources as documents, documents as their pages."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return docs.select("source", "doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))


def repeated_headers(spark, sf_dir):
    """A3 with a low bar: the corpus has few repeated lines."""
    rows = _source_lines(spark, sf_dir).withColumn("signature", X.signature(F.col("line"))).where("signature <> ''")
    return rows.groupBy("source", "signature").agg(F.countDistinct("doc_id").alias("pages")).where(f"pages >= {headers.MIN_PAGES}")


def strip_headers(spark, sf_dir):
    """lines left per document without its source's repeated signatures."""
    # texts are looked at once: counting and matching take hashes and lengths
    marked = headers.with_marks(_source_lines(spark, sf_dir)).select("source", "doc_id", F.length("line").alias("chars"), "mark")
    left = headers.without_repeated(settle(marked, "lines"), "source", "doc_id")
    return left.groupBy("doc_id").agg(F.count("*").alias("lines_left"), F.sum("chars").alias("chars_left"))


SIGNATURE_SQL = rf"""CASE WHEN regexp_matches(regexp_replace(regexp_replace(lower(trim(line, {STRIP})), '[0-9]+', '#', 'g'), '[ \t\n\v\f\r]+', ' ', 'g'), '^[#.,|\-/\\ ]*$') THEN ''
  ELSE regexp_replace(regexp_replace(lower(trim(line, {STRIP})), '[0-9]+', '#', 'g'), '[ \t\n\v\f\r]+', ' ', 'g') END"""
REPEATED_SQL = f"""
ln AS (SELECT source, doc_id, {SPLIT_LINES} FROM documents), sg AS (SELECT *, {SIGNATURE_SQL} AS signature FROM ln),
rep AS (SELECT source, signature, count(DISTINCT doc_id) AS pages FROM sg WHERE signature <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3)"""


def html_blocks(spark, sf_dir):
    return corpus.html_blocks(table(spark, sf_dir, "pages")).groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def section_cache_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", store.section_cache_key(F.col("source"), F.lit(2), F.col("text"), F.array("lang"), "p1").alias("cache_key"))


def cache_hits(spark, sf_dir):
    """Every third document is cached; the others are computed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = docs.where("doc_id % 3 = 0").select("doc_id", F.lit("held").alias("payload"))
    return store.with_cache(docs.select("doc_id"), held, ["doc_id"], lambda m: m.withColumn("payload", F.lit("made")))


def upsert_latest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.select(_path().alias("id"), F.col("n_chars").alias("payload"), F.lit(1).alias("version"))
    new = docs.where("doc_id % 4 = 1").select(_path().alias("id"), (F.col("n_chars") + 1).alias("payload"), F.lit(2).alias("version"))
    return store.latest_by_key(old, new, "id", "version")


def corpus_listing(spark, sf_dir):
    """Files per folder, in order."""
    docs = table(spark, sf_dir, "documents").select(X.folder_of(_path()).alias("folder"), _path().alias("path"))
    return docs.withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy("path")))


QUERIES = {
    "page_scan": (page_scan, f"WITH {PAGES_SQL} SELECT * FROM pages_"),
    "route_documents": (route_documents, f"WITH {PAGES_SQL}, c AS (SELECT doc_id, count(*) AS n FROM pages_ GROUP BY ALL) SELECT doc_id, coalesce(n, 0) AS n_pages, CASE WHEN n > 1 THEN 'compliance' ELSE 'narrative' END AS doc_type FROM documents LEFT JOIN c USING (doc_id)"),
    "sentence_split": (sentence_split, rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\v\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {STRIP})), lambda x: x <> '') AS ss FROM documents)
SELECT doc_id, generate_subscripts(ss, 1) - 1 AS sentence_no, unnest(ss) AS sentence FROM s"""),
    "paragraph_units": (paragraph_units, rf"""SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '\n\n+'), lambda x: trim(x, {STRIP})), lambda x: x <> '')) AS n_paragraphs,
len(list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(x, {STRIP})), lambda x: x <> '')) AS n_lines FROM documents"""),
    "folder_of": (folder_of, "SELECT doc_id, source AS folder, '' AS bare FROM documents"),
    "corpus_listing": (corpus_listing, "SELECT source AS folder, source || '/' || doc_id || '.pdf' AS path, row_number() OVER (PARTITION BY source ORDER BY source || '/' || doc_id || '.pdf') AS place FROM documents"),
    "chunk_pack": (chunk_pack, f"{_recursive_chunks(2000, 0)} SELECT * FROM chunks"),
    "chunk_pack_overlap": (chunk_pack_overlap, f"{_recursive_chunks(300, 75)} SELECT *, 1 AS page_number, split_part(source_file, '/', 1) AS folder FROM chunks"),
    "chunk_stats": (chunk_stats, f"{_recursive_chunks(2000, 0)} SELECT count(DISTINCT source_file) AS files, count(*) AS chunks, sum(length(text)) AS chars FROM chunks"),
    "signatures": (signatures, f"WITH ln AS (SELECT {SPLIT_LINES} FROM documents), sg AS (SELECT {SIGNATURE_SQL} AS signature FROM ln) SELECT signature, count(*) AS n FROM sg WHERE signature <> '' GROUP BY ALL"),
    "repeated_headers": (repeated_headers, f"WITH {REPEATED_SQL} SELECT * FROM rep"),
    "strip_headers": (strip_headers, f"WITH {REPEATED_SQL} SELECT doc_id, count(*) AS lines_left, sum(length(line)) AS chars_left FROM sg ANTI JOIN rep USING (source, signature) GROUP BY ALL"),
    "html_blocks": (html_blocks, rf"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<(h[1-6]|p|li)\b[^>]*>([^<]|<[^hpl/]|<l[^i]|</[^ahupl]|</a>|<p[^ >])*', 0)) AS raw FROM pages),
t AS (SELECT page_id, regexp_extract(raw, '^<([a-z0-9]+)', 1) AS tag, trim(regexp_replace(raw, '<[^>]*>', '', 'g'), {STRIP}) AS text FROM b) SELECT page_id, tag, count(*) AS n, sum(length(text)) AS chars FROM t GROUP BY ALL"""),
    "content_hash": (content_hash, "SELECT doc_id, sha256(text) AS sha256 FROM documents"),
    "section_cache_key": (section_cache_key, "SELECT doc_id, sha256(text || lang || chr(0) || source || chr(0) || '2' || chr(0) || 'p1') AS cache_key FROM documents"),
    "cache_hits": (cache_hits, "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'held' ELSE 'made' END AS payload, doc_id % 3 = 0 AS cached FROM documents"),
    "upsert_latest": (upsert_latest, "SELECT source || '/' || doc_id || '.pdf' AS id, n_chars + (doc_id % 4 = 1)::int AS payload, 1 + (doc_id % 4 = 1)::int AS version FROM documents"),
}
