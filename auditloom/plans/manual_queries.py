"""Queries over the derived regulatory corpus: sections, obligations, tables, terms, references, lists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import headers, lines, lists, review, terms, xref
from . import derived
from .derived import SECTIONS_SQL

WITH = f"WITH {SECTIONS_SQL}"
OBLIGATION = "|".join(X.OBLIGATION_GROUPS.values())
KEPT_SQL = f"flagged AS (SELECT *, len(tables) > 0 OR regexp_matches(text || array_to_string(tables, chr(10)), '{OBLIGATION}') AS kept FROM merged)"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.merge_empty(lines.segment(derived.lines(spark, sf_dir)))


def text_round_trip(spark, sf_dir):
    """Lines to text and back; numbers are then those of the text."""
    return lines.to_lines(lines.to_text(derived.lines(spark, sf_dir)))


def typed_lines(spark, sf_dir):
    return lines.typed(derived.lines(spark, sf_dir)).select("doc_id", "line_no", "kind", "page", "level")


def segment(spark, sf_dir):
    return lines.segment(derived.lines(spark, sf_dir))


def merge_empty(spark, sf_dir):
    return sections(spark, sf_dir)


def subsplit(spark, sf_dir):
    return lines.sub_split(sections(spark, sf_dir)).select("doc_id", "section_no", "piece_no", "heading", "text", "char_count", F.size("tables").alias("n_tables"))


def obligation_filter(spark, sf_dir):
    return lines.flag_obligations(sections(spark, sf_dir)).select("doc_id", "section_no", "kept")


def obligation_counts(spark, sf_dir):
    flagged = lines.flag_obligations(sections(spark, sf_dir))
    return flagged.groupBy("doc_id").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("skipped"), F.count("*").alias("total"))


def obligation_classes(spark, sf_dir):
    s = sections(spark, sf_dir)
    return s.select("doc_id", "section_no", *(c.alias(n) for n, c in X.obligation_classes(F.col("text")).items()))


def split_large_small(spark, sf_dir):
    return lines.split_large(sections(spark, sf_dir)).select("doc_id", "section_no", "large")


def batch_sections(spark, sf_dir):
    return lines.batch_small(sections(spark, sf_dir), 800, 3)


def pipe_tables(spark, sf_dir):
    return terms.pipe_tables(sections(spark, sf_dir)).select("doc_id", "section_no", "table_no", "row_no", F.array_join("header", "|").alias("header"), F.array_join("cells", "|").alias("cells"))


def table_requirements(spark, sf_dir):
    return terms.requirement_rows(sections(spark, sf_dir))


def glossary_terms(spark, sf_dir):
    return terms.glossary_terms(sections(spark, sf_dir)).select("doc_id", "term", "definition", "page_start", "heading")


def inline_acronyms(spark, sf_dir):
    return terms.inline_acronyms(derived.lines(spark, sf_dir)).select("doc_id", "term", "abbreviation", "definition", "page")


def definition_tables(spark, sf_dir):
    return terms.definition_tables(sections(spark, sf_dir)).select("doc_id", "term", "definition", "page_start", "heading")


def _terms(spark, sf_dir) -> DataFrame:
    d = derived.lines(spark, sf_dir)
    return terms.all_terms(d, lines.merge_empty(lines.segment(d))).withColumn("source_file", F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")))


def all_terms(spark, sf_dir):
    return _terms(spark, sf_dir).drop("source_file")


def term_documents(spark, sf_dir):
    return terms.term_rows(_terms(spark, sf_dir)).select("id", "document")


def define_term(spark, sf_dir):
    asked = spark.createDataFrame([("ecm",), ("ECM",), ("Outreach",), ("outreach",), ("Population of Focus",)], "query string")
    return terms.define(_terms(spark, sf_dir), asked).select("query", "doc_id", "term", "definition")


def format_definitions(spark, sf_dir):
    t = _terms(spark, sf_dir)
    text = X.definition_text(F.col("term"), F.col("abbreviation"), F.col("definition"), F.col("source_file"), F.col("page_number"), F.col("section_heading"))
    return t.withColumn("_t", text).groupBy("doc_id").agg(lines.joined("term", "_t", "\n---\n").alias("text"))


def section_numbers(spark, sf_dir):
    return sections(spark, sf_dir).select("doc_id", "section_no", X.section_number(F.col("heading")).alias("number"), X.normal_key(F.col("heading")).alias("key"))


def detect_refs(spark, sf_dir):
    return xref.detect(sections(spark, sf_dir)).drop("norm")


def section_keys(spark, sf_dir):
    return xref.index(sections(spark, sf_dir)).select("doc_id", "key", "heading", F.length("body").alias("body_chars"))


def resolve_refs(spark, sf_dir):
    return xref.resolve_sections(sections(spark, sf_dir)).select("doc_id", "section_no", "rank", "target_key", "heading", "summary")


def ref_context(spark, sf_dir):
    return xref.context(xref.resolve_sections(sections(spark, sf_dir)))


def lookup_sections(spark, sf_dir):
    s = sections(spark, sf_dir)
    ids = F.array(*(F.lit(x) for x in ("III.A", "iii.a", " ", "4.2", "nowhere", "Appendix B")))
    asked = s.select("doc_id").distinct().select("doc_id", F.lit(1).alias("request_no"), F.posexplode(ids).alias("id_no", "section_id"))
    return xref.lookup(asked, xref.index(s)).select("doc_id", "text")


def truncated(spark, sf_dir):
    return sections(spark, sf_dir).select("doc_id", "section_no", X.truncate(F.col("text"), 60).alias("cut"))


def render_section(spark, sf_dir):
    return sections(spark, sf_dir).select("doc_id", "section_no", X.section_text(F.col("heading"), F.col("page_start"), F.col("page_end"), F.col("text"), F.col("tables")).alias("rendered"))


def batch_prompt(spark, sf_dir):
    s = sections(spark, sf_dir)
    entry = X.batch_entry(F.col("heading"), F.col("page_start"), F.col("text"), F.col("tables"))
    return s.join(lines.batch_small(s, 800, 3), ["doc_id", "section_no"]).withColumn("_e", entry).groupBy("doc_id", "batch_no").agg(lines.joined("section_no", "_e", "\n").alias("prompt"))


def _lists(spark, sf_dir) -> DataFrame:
    return derived.lines(spark, sf_dir, derived.LISTS)


def list_items(spark, sf_dir):
    return lists.items(_lists(spark, sf_dir))


def list_levels(spark, sf_dir):
    return lists.levels(lists.items(_lists(spark, sf_dir))).select("doc_id", "node_no", "level")


def list_paths(spark, sf_dir):
    return lists.parse(_lists(spark, sf_dir))


def list_trees(spark, sf_dir):
    return lists.trees(lists.parse(_lists(spark, sf_dir)))


def review_form_questions(spark, sf_dir):
    text = lines.to_text(derived.lines(spark, sf_dir)).where(X.is_checklist(F.col("text")))
    p = X.CHECKLIST_QUESTION
    found = F.arrays_zip(*(F.expr(f"regexp_extract_all(text, r'{p}', {k})").alias(n) for k, n in ((1, "id"), (2, "q"), (3, "r"))))
    return text.select("doc_id", F.explode(found).alias("m")).select("doc_id", F.col("m.id").cast("int").alias("id"), X.clean_question(F.col("m.q")).alias("text"), X.strip(F.col("m.r")).alias("reference"))


def _requirements(spark, sf_dir) -> DataFrame:
    """A requirement per section, in order of the sections."""
    return sections(spark, sf_dir).select("doc_id", F.col("section_no").alias("seq"), F.col("heading").alias("section_heading"), "text")


def hierarchy(spark, sf_dir):
    return review.hierarchy(_requirements(spark, sf_dir), sections(spark, sf_dir)).select("doc_id", "id", "parent_id", "level")


def parent_integrity(spark, sf_dir):
    return review.orphan_parents(review.hierarchy(_requirements(spark, sf_dir), sections(spark, sf_dir))).agg(F.count("*").alias("orphans"))


def blocks(spark, sf_dir) -> DataFrame:
    """Layout blocks: a derived line is a block, its height from its place on the page; tables are rectangles."""
    t = lines.typed(derived.lines(spark, sf_dir))
    w = F.row_number().over(lines.Window.partitionBy("doc_id", "page").orderBy("line_no"))
    t = t.where("kind <> 'page'").withColumn("k", w)
    foot = F.col("line").rlike("^Page [0-9] of 4$")
    head = F.col("line").startswith("Plan Manual")
    y0 = F.when(head, 30).when(foot, 780).otherwise(90 + 25 * F.col("k")).cast("double")
    size = F.when(F.col("kind") == "heading", 18.0 - F.col("level")).otherwise(10.0)
    return t.select("doc_id", F.col("page").alias("page_number"), F.col("line_no").alias("src_no"), F.when(F.col("kind").isin("table_start", "table_end"), 1).otherwise(0).alias("type"), F.lit(50.0).alias("x0"), y0.alias("y0"), F.lit(500.0).alias("x1"), (y0 + F.when(F.col("kind") == "table_start", 60).otherwise(12)).alias("y1"), F.lit(800.0).alias("page_height"), size.alias("size"), F.col("line").alias("text"))


BLOCKS_SQL = f"""{WITH}, bk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS k FROM kinds WHERE kind <> 'page'),
bl AS (SELECT doc_id, page AS page_number, line_no AS src_no, CASE WHEN kind IN ('table_start', 'table_end') THEN 1 ELSE 0 END AS type, 50.0::double AS x0,
  (CASE WHEN line LIKE 'Plan Manual%' THEN 30 WHEN regexp_matches(line, '^Page [0-9] of 4$') THEN 780 ELSE 90 + 25 * k END)::double AS y0, 500.0::double AS x1, kind, lv, line AS text FROM bk),
blocks_ AS (SELECT *, y0 + CASE WHEN kind = 'table_start' THEN 60 ELSE 12 END AS y1, 800.0::double AS page_height, (CASE WHEN kind = 'heading' THEN 18 - lv ELSE 10 END)::double AS size FROM bl),
np AS (SELECT doc_id, count(DISTINCT page_number) AS n_pages FROM blocks_ GROUP BY ALL),
zoned AS (SELECT *, CASE WHEN y0 / 800 < 0.12 THEN 'header' WHEN y1 / 800 > 0.88 THEN 'footer' END AS zone, round(round_even(y0 / 800 / 0.025, 0) * 0.025, 4) AS bucket, {{sig}} AS signature FROM blocks_),
reps AS (SELECT doc_id, signature, count(DISTINCT page_number) AS pages FROM zoned WHERE type = 0 AND zone IS NOT NULL AND signature <> '' GROUP BY ALL),
rs AS (SELECT doc_id, signature, pages FROM reps JOIN np USING (doc_id) WHERE n_pages >= 2 AND pages >= greatest(3, ceil(0.55 * n_pages))),
repb AS (SELECT doc_id, zone, bucket, count(DISTINCT page_number) AS pages FROM zoned WHERE type = 0 AND zone IS NOT NULL GROUP BY ALL),
rb AS (SELECT doc_id, zone, bucket, pages FROM repb JOIN np USING (doc_id) WHERE n_pages >= 2 AND pages >= greatest(3, ceil(0.55 * n_pages))),
fs AS (SELECT doc_id, round(size, 1) AS size, sum(length(text)) AS chars, min(page_number * 100000 + src_no) AS fst FROM blocks_ WHERE type = 0 GROUP BY ALL),
bd AS (SELECT doc_id, arg_max(size, chars * 10000000000::hugeint - fst) AS body FROM fs GROUP BY ALL),
hs AS (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC) AS level FROM fs JOIN bd USING (doc_id) WHERE size > body + 0.5 QUALIFY level <= 3)
""".replace("{sig}", r"""CASE WHEN regexp_matches(regexp_replace(regexp_replace(lower(trim(text)), '[0-9]+', '#', 'g'), '[ \t]+', ' ', 'g'), '^[#.,|\-/\\ ]*$') THEN '' ELSE regexp_replace(regexp_replace(lower(trim(text)), '[0-9]+', '#', 'g'), '[ \t]+', ' ', 'g') END""")


def zone_signatures(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return headers.repeated_signatures(headers.in_zones(b), n_pages=headers.page_counts(b))


def y_buckets(spark, sf_dir):
    return headers.repeated_buckets(blocks(spark, sf_dir))


def zone_filter(spark, sf_dir):
    return headers.drop_headers(blocks(spark, sf_dir)).select("doc_id", "page_number", "src_no")


def font_sizes(spark, sf_dir):
    return headers.font_sizes(blocks(spark, sf_dir)).select("doc_id", "size", "chars")


def heading_levels(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return headers.heading_levels(b, headers.heading_sizes(headers.font_sizes(b))).select("doc_id", "page_number", "src_no", "level")


def block_minus_tables(spark, sf_dir):
    return headers.minus_tables(blocks(spark, sf_dir)).select("doc_id", "page_number", "src_no")


def page_order(spark, sf_dir):
    return headers.page_order(blocks(spark, sf_dir)).select("doc_id", "page_number", "src_no", "place")


PIPES_SQL = """ptab AS (SELECT doc_id, section_no, heading, page_start, generate_subscripts(tables, 1) - 1 AS table_no, unnest(tables) AS tb FROM merged),
plin AS (SELECT *, list_filter(list_transform(string_split(tb, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM ptab),
prow AS (SELECT *, list_transform(list_filter(list_transform(string_split(ls[1], '|'), lambda x: trim(x)), lambda x: x <> ''), lambda x: lower(x)) AS header, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS row_no FROM plin),
pipes AS (SELECT *, list_filter(list_transform(string_split(l, '|'), lambda x: trim(x)), lambda x: x <> '') AS cells FROM prow WHERE row_no > 0)"""


def _col(words: str, fallback: str) -> str:
    return f"coalesce(list_position(list_transform(header, lambda h: regexp_matches(h, '{words}')), true) - 1, {fallback})"


GLOSS_SQL = rf"""{PIPES_SQL},
gt0 AS (SELECT *, {_col("term|criteria|name|abbr", "0")} AS tc, {_col("definition|description|meaning|criteria", "1")} AS dc0 FROM pipes WHERE regexp_matches(heading, '(?i)^(?:appendix\s+[a-z]:\s*)?(definitions?|glossary|abbreviations?|acronyms?|key\s+terms?)\b') AND len(header) >= 2),
gt1 AS (SELECT *, CASE WHEN tc = dc0 THEN CASE WHEN tc = 0 THEN 1 ELSE 0 END ELSE dc0 END AS dc FROM gt0),
gl0 AS (SELECT doc_id, section_no, page_start, heading, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM merged WHERE regexp_matches(heading, '(?i)^(?:appendix\s+[a-z]:\s*)?(definitions?|glossary|abbreviations?|acronyms?|key\s+terms?)\b')),
gl1 AS (SELECT *, trim(regexp_extract(l, '^[-\x{{2022}}*]?\s*([A-Z][^\n:\x{{2014}}\-]{{1,80}}?)\s*(?:[:\x{{2014}}\-]\s*)(.{{10,}}?)$', 1)) AS term, trim(regexp_extract(l, '^[-\x{{2022}}*]?\s*([A-Z][^\n:\x{{2014}}\-]{{1,80}}?)\s*(?:[:\x{{2014}}\-]\s*)(.{{10,}}?)$', 2)) AS definition FROM gl0),
ga AS (SELECT doc_id, section_no, 0 AS kind, table_no AS a, row_no AS b, cells[tc + 1] AS term, cells[dc + 1] AS definition, page_start, heading FROM gt1 WHERE len(cells) > greatest(tc, dc)
  UNION ALL SELECT doc_id, section_no, 1, i, 0, term, definition, page_start, heading FROM gl1 WHERE term <> '' AND len(regexp_split_to_array(term, '\s+')) <= 8),
gloss AS (SELECT *, lower(term) AS key FROM ga WHERE term <> '' AND length(definition) >= 10 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(term) ORDER BY section_no, kind, a, b) = 1),
whole AS (SELECT doc_id, string_split(string_agg(line, chr(10) ORDER BY line_no), '[PAGE ') AS parts FROM lines GROUP BY ALL),
leaf AS (SELECT doc_id, unnest(parts) AS g, generate_subscripts(parts, 1) AS s FROM whole),
ac0 AS (SELECT doc_id, s, CASE WHEN s = 1 THEN 1 ELSE regexp_extract(g, '^(\d+)\]', 1)::int END AS page, unnest(regexp_extract_all(g, '{X.INLINE_ACRONYM}', 1)) AS ph, unnest(regexp_extract_all(g, '{X.INLINE_ACRONYM}', 2)) AS ab, generate_subscripts(regexp_extract_all(g, '{X.INLINE_ACRONYM}', 1), 1) AS k FROM leaf),
ac1 AS (SELECT doc_id, s, k, page, trim(ph) AS term, trim(ab) AS abbreviation FROM ac0 WHERE regexp_matches(array_to_string(list_transform(list_filter(regexp_split_to_array(trim(ph), '[\s/&\-]+'), lambda w: w <> ''), lambda w: upper(w[1])), ''), array_to_string(string_split(regexp_replace(upper(ab), '[^A-Z0-9]', '', 'g'), ''), '.*'))),
acr AS (SELECT * FROM ac1 QUALIFY row_number() OVER (PARTITION BY doc_id, upper(abbreviation) ORDER BY s, k) = 1),
inl AS (SELECT *, term || ' (' || abbreviation || ')' AS definition FROM acr),
dt0 AS (SELECT *, {_col("term|criteria|name", "0")} AS tc, {_col("definition|description|meaning", "1")} AS dc FROM pipes WHERE NOT regexp_matches(heading, '(?i)^(?:appendix\s+[a-z]:\s*)?(definitions?|glossary|abbreviations?|acronyms?|key\s+terms?)\b') AND regexp_matches(array_to_string(header, ' '), 'definition|criteria|meaning')),
dtab AS (SELECT doc_id, cells[tc + 1] AS term, cells[dc + 1] AS definition, page_start, heading FROM dt0 WHERE tc <> dc AND len(cells) > greatest(tc, dc) AND cells[tc + 1] <> '' AND length(cells[dc + 1]) >= 10
  QUALIFY row_number() OVER (PARTITION BY doc_id, lower(cells[tc + 1]) ORDER BY section_no, table_no, row_no) = 1),
terms_ AS (SELECT doc_id, 1 AS priority, term, NULL::varchar AS abbreviation, definition, page_start AS page_number, heading AS section_heading, 'glossary' AS source FROM gloss
  UNION ALL SELECT doc_id, 2, term, abbreviation, definition, page, NULL, 'inline_acronym' FROM inl WHERE NOT EXISTS (SELECT 1 FROM gloss g WHERE g.doc_id = inl.doc_id AND g.key = lower(inl.term))
  UNION ALL SELECT doc_id, 3, term, NULL, definition, page_start, heading, 'definition_table' FROM dtab WHERE NOT EXISTS (SELECT 1 FROM gloss g WHERE g.doc_id = dtab.doc_id AND g.key = lower(dtab.term)) AND NOT EXISTS (SELECT 1 FROM inl g WHERE g.doc_id = dtab.doc_id AND lower(g.term) = lower(dtab.term)))"""

KEY = lambda c: f"regexp_replace(rtrim(lower(trim({c})), '.,;'), '\\s+', ' ', 'g')"


def _re2(pattern: str) -> str:
    """A pattern without the look-ahead that DuckDB lacks; the corpus has what it asks for after every match."""
    return re.sub(r"\(\?=.*\)$", "", pattern)


_FOUND = [f"nullif(regexp_extract(trim(heading), '{p}', 1), '')" for p in X.NUMBERED]
NUMBER_SQL = f"coalesce(upper({_FOUND[0]}), rtrim({_FOUND[1]}, '.'), rtrim({_FOUND[2]}, '.'), {_FOUND[3]}, {_FOUND[4]})"
_REFS = [_re2(p) for _, p in xref.PATTERNS]
REFS_SQL = (
    "rr AS ("
    + " UNION ALL ".join(f"SELECT doc_id, section_no, {n} AS p, generate_subscripts(regexp_extract_all(text, '{p}', 0), 1) AS i, unnest(regexp_extract_all(text, '{p}', 0)) AS raw, unnest(regexp_extract_all(text, '{p}', 1)) AS tg FROM merged" for n, p in enumerate(_REFS))
    + f"""), r1 AS (SELECT doc_id, section_no, p, i, trim(raw, ' ' || chr(10)) AS raw_text, rtrim(trim(tg), '.') AS target_key, {KEY("rtrim(trim(tg), '.')")} AS norm FROM rr),
refs AS (SELECT * FROM r1 QUALIFY row_number() OVER (PARTITION BY doc_id, section_no, norm ORDER BY p, i) = 1),
refs_ AS (SELECT doc_id, section_no, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY p, i) AS ref_no, raw_text, target_key, norm, CASE WHEN regexp_matches(target_key, '(?i)^[A-Z]$') THEN 'appendix' WHEN p = 4 THEN 'cfr' ELSE 'section' END AS ref_type FROM refs),
k0 AS (SELECT doc_id, section_no, heading, trim(trim(text, ' ' || chr(10)) || CASE WHEN len(tables) > 0 THEN chr(10) || array_to_string(tables, chr(10)) ELSE '' END, ' ' || chr(10)) AS body, {NUMBER_SQL} AS num, trim(regexp_replace(heading, '(?i)^[IVXLCDM0-9][A-Z0-9.\\-]*\\.?\\s+', '')) AS rest FROM merged),
k1 AS (SELECT doc_id, section_no, heading, body, unnest([0, 1, 2, 3]) AS k, unnest([heading, num, regexp_replace(num, '(?i)^(?:appendix|annex|exhibit)\\s*', ''), CASE WHEN rest <> '' AND rest <> heading THEN rest END]) AS rk FROM k0),
keys_ AS (SELECT doc_id, {KEY("rk")} AS key, section_no * 4 + k AS seq, heading, body FROM k1 WHERE {KEY("rk")} <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, {KEY("rk")} ORDER BY section_no, k) = 1),
rs0 AS (SELECT r.*, k.heading, k.body, k.seq, CASE WHEN k.key = r.norm THEN 1 WHEN starts_with(k.key, r.norm) THEN 2 ELSE 3 END AS rule FROM refs_ r JOIN keys_ k ON k.doc_id = r.doc_id AND (k.key = r.norm OR (length(r.norm) >= 2 AND starts_with(k.key, r.norm)) OR (length(k.key) >= 2 AND starts_with(r.norm, k.key))) WHERE r.ref_type <> 'cfr'),
rs1 AS (SELECT * FROM rs0 QUALIFY row_number() OVER (PARTITION BY doc_id, section_no, ref_no ORDER BY rule, seq) = 1),
rs2 AS (SELECT rs1.*, {{cut}} AS summary FROM rs1 JOIN (SELECT doc_id, section_no, heading AS own FROM merged) USING (doc_id, section_no) WHERE own = '' OR {KEY("rs1.heading")} <> {KEY("own")}),
resolved AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY ref_no) AS rank FROM rs2 WHERE summary <> '' QUALIFY rank <= 6)"""
)


def _cut(c: str, n: int) -> str:
    """F17 in DuckDB: the last '. ' of the head is found in the reversed head."""
    head = f"trim({c}, ' ' || chr(10))[1:{n}]"
    last = f"CASE WHEN strpos(reverse({head}), ' .') > 0 THEN length({head}) - strpos(reverse({head}), ' .') - 1 ELSE -1 END"
    return f"CASE WHEN length(trim({c}, ' ' || chr(10))) <= {n} THEN trim({c}, ' ' || chr(10)) ELSE trim(CASE WHEN ({last}) > {n // 2} THEN ({head})[1:({last}) + 1] ELSE {head} END, ' ' || chr(10)) || ' …' END"


REFS_SQL = REFS_SQL.replace("{cut}", _cut("body", 450))
MARK = "[0-9]{1,3}|[A-Za-z]|" + "|".join(sorted((r for r in X.LOWER_ROMAN if len(r) > 1), key=lambda r: (-len(r), r)))
_LI = rf"^([ \t]*)(?:\(({MARK})\)[ \t]+|({MARK})([.)])[ \t]+)(\S.*)$"
LISTS_SQL = rf"""WITH RECURSIVE ll AS ({derived.lines_sql(derived.LISTS)}),
li AS (SELECT *, coalesce(nullif(regexp_extract(line, '{_LI}', 2), ''), regexp_extract(line, '{_LI}', 3)) AS marker, list_reduce(list_prepend(0, list_transform(string_split(regexp_extract(line, '{_LI}', 1), ''), lambda c: CASE c WHEN chr(9) THEN -1 ELSE length(c) END)), lambda n, c: CASE WHEN c < 0 THEN (n // 4 + 1) * 4 ELSE n + c END)::int AS indent,
  CASE WHEN regexp_extract(line, '{_LI}', 2) <> '' THEN '(' || regexp_extract(line, '{_LI}', 2) || ')' ELSE regexp_extract(line, '{_LI}', 3) || regexp_extract(line, '{_LI}', 4) END AS display, trim(regexp_extract(line, '{_LI}', 5)) AS body FROM ll),
ln AS (SELECT *, (count(*) FILTER (marker <> '') OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))::int AS node_no FROM li),
items AS (SELECT doc_id, node_no, max(indent) FILTER (marker <> '') AS indent, max(marker) FILTER (marker <> '') AS marker, max(display) FILTER (marker <> '') AS display, string_agg(CASE WHEN marker <> '' THEN body ELSE trim(line) END, ' ' ORDER BY line_no) AS text FROM ln WHERE node_no > 0 AND trim(line) <> '' GROUP BY ALL),
ityped AS (SELECT *, CASE WHEN regexp_matches(marker, '^[0-9]+$') THEN 'decimal' WHEN marker IN ({", ".join(f"'{r}'" for r in X.LOWER_ROMAN)}) THEN 'lower_roman' WHEN regexp_matches(marker, '^[a-z]$') THEN 'lower_alpha' WHEN regexp_matches(marker, '^[A-Z]$') THEN 'upper_alpha' ELSE 'unknown' END AS kind FROM items),
dense AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY indent) AS byi FROM ityped),
cnt AS (SELECT doc_id, count(DISTINCT indent) AS ni FROM ityped GROUP BY ALL),
walk(doc_id, node_no, stack, lvl) AS (SELECT doc_id, 0, []::varchar[], 0 FROM cnt UNION ALL
  SELECT t.doc_id, t.node_no, CASE WHEN t.kind = 'unknown' THEN w.stack WHEN list_contains(w.stack, t.kind) THEN w.stack[1:list_position(w.stack, t.kind)] ELSE list_append(w.stack, t.kind) END,
    CASE WHEN t.kind = 'unknown' THEN greatest(len(w.stack), 1) WHEN list_contains(w.stack, t.kind) THEN list_position(w.stack, t.kind) ELSE len(w.stack) + 1 END::int FROM walk w JOIN ityped t ON t.doc_id = w.doc_id AND t.node_no = w.node_no + 1),
lev AS (SELECT d.*, (CASE WHEN ni > 1 THEN byi ELSE lvl END)::int AS level FROM dense d JOIN cnt USING (doc_id) JOIN walk w ON w.doc_id = d.doc_id AND w.node_no = d.node_no),
tree(doc_id, node_no, parent_no, path, stack) AS (SELECT doc_id, 0, NULL::int, '', []::struct(n int, p varchar)[] FROM cnt UNION ALL
  SELECT l.doc_id, l.node_no, CASE WHEN l.level > 1 THEN t.stack[1:l.level - 1][-1].n END,
    CASE WHEN l.level > 1 AND len(t.stack) >= l.level - 1 THEN t.stack[l.level - 1].p || '.' || lower(l.marker) ELSE lower(l.marker) END,
    list_append(t.stack[1:l.level - 1], {{'n': l.node_no, 'p': CASE WHEN l.level > 1 AND len(t.stack) >= l.level - 1 THEN t.stack[l.level - 1].p || '.' || lower(l.marker) ELSE lower(l.marker) END}}) FROM tree t JOIN lev l ON l.doc_id = t.doc_id AND l.node_no = t.node_no + 1)
"""
SUB_SQL = f"""{WITH}, pp AS (SELECT doc_id, section_no, list_filter(list_transform(regexp_split_to_array(text, '\\n\\n+'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS ps FROM merged WHERE char_count > 5000),
fold AS (SELECT doc_id, section_no, list_reduce(list_prepend({{'done': []::varchar[], 'cur': ''}}, list_transform(ps, lambda p: {{'done': []::varchar[], 'cur': p}})), lambda s, p: CASE WHEN s.cur <> '' AND length(s.cur) + 2 + length(p.cur) > 5000 THEN {{'done': list_append(s.done, s.cur), 'cur': p.cur}} WHEN s.cur = '' THEN {{'done': s.done, 'cur': p.cur}} ELSE {{'done': s.done, 'cur': s.cur || chr(10) || chr(10) || p.cur}} END) AS r FROM pp),
pieces AS (SELECT doc_id, section_no, list_append(r.done, r.cur) AS ts FROM fold),
spl AS (SELECT m.doc_id, m.section_no, m.heading, m.tables, coalesce(ts, [m.text]) AS ts FROM merged m LEFT JOIN pieces USING (doc_id, section_no)),
sx AS (SELECT *, unnest(ts) AS text, generate_subscripts(ts, 1) - 1 AS piece_no FROM spl)"""

QUERIES = {
    "text_round_trip": (text_round_trip, f"WITH l AS ({derived.lines_sql()}) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS line_no, line FROM l"),
    "typed_lines": (typed_lines, f"{WITH} SELECT doc_id, line_no, kind, page, CASE WHEN kind = 'heading' THEN lv END AS level FROM kinds"),
    "segment": (segment, f"{WITH} SELECT * FROM sections"),
    "merge_empty": (merge_empty, f"{WITH} SELECT * FROM merged"),
    "subsplit": (subsplit, f"{SUB_SQL} SELECT doc_id, section_no, piece_no, heading || CASE WHEN piece_no > 0 THEN ' (cont.)' ELSE '' END AS heading, text, length(text) AS char_count, CASE WHEN piece_no = 0 THEN len(tables) ELSE 0 END AS n_tables FROM sx"),
    "obligation_filter": (obligation_filter, f"{WITH}, {KEPT_SQL} SELECT doc_id, section_no, kept FROM flagged"),
    "obligation_counts": (obligation_counts, f"{WITH}, {KEPT_SQL} SELECT doc_id, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS skipped, count(*) AS total FROM flagged GROUP BY ALL"),
    "obligation_classes": (obligation_classes, f"{WITH} SELECT doc_id, section_no, " + ", ".join(f"regexp_matches(text, '{p}') AS {n}" for n, p in X.OBLIGATION_GROUPS.items()) + " FROM merged"),
    "split_large_small": (split_large_small, f"{WITH} SELECT doc_id, section_no, char_count >= 800 OR len(tables) > 0 AS large FROM merged"),
    "batch_sections": (batch_sections, f"{WITH} SELECT doc_id, section_no, ((row_number() OVER (PARTITION BY doc_id ORDER BY section_no) - 1) // 3)::int AS batch_no FROM merged WHERE NOT (char_count >= 800 OR len(tables) > 0)"),
    "pipe_tables": (pipe_tables, f"{WITH}, {PIPES_SQL} SELECT doc_id, section_no, table_no, row_no, array_to_string(header, '|') AS header, array_to_string(cells, '|') AS cells FROM pipes WHERE len(cells) > 0"),
    "table_requirements": (table_requirements, f"""{WITH}, {PIPES_SQL}, rq AS (SELECT *, {_col("requirement|description|obligation|control", "-1")} AS tx, {_col("owner|responsible|party|actor|role", "-1")} AS ac, {_col("deadline|frequency|timeframe|period", "-1")} AS tf, {_col("evidence|documentation|artifact", "-1")} AS ev FROM pipes)
SELECT doc_id, section_no, table_no, row_no, 'Does the P&P state that ' || cells[tx + 1] || '?' AS text, cells[tx + 1] AS exact_quote, heading || ', page ' || page_start AS reference, CASE WHEN ac >= 0 THEN cells[ac + 1] END AS actor, CASE WHEN tf >= 0 THEN cells[tf + 1] END AS timeframe, CASE WHEN ev >= 0 THEN cells[ev + 1] END AS evidence_needed, heading AS section_heading FROM rq WHERE tx >= 0 AND len(cells) > tx"""),
    "glossary_terms": (glossary_terms, f"{WITH}, {GLOSS_SQL} SELECT doc_id, term, definition, page_start, heading FROM gloss"),
    "inline_acronyms": (inline_acronyms, f"{WITH}, {GLOSS_SQL} SELECT doc_id, term, abbreviation, definition, page FROM inl"),
    "definition_tables": (definition_tables, f"{WITH}, {GLOSS_SQL} SELECT doc_id, term, definition, page_start, heading FROM dtab"),
    "all_terms": (all_terms, f"{WITH}, {GLOSS_SQL} SELECT * FROM terms_"),
    "term_documents": (term_documents, f"{WITH}, {GLOSS_SQL} SELECT doc_id || '.pdf::' || coalesce(abbreviation, term) AS id, term || CASE WHEN abbreviation IS NOT NULL THEN ' (' || abbreviation || ')' ELSE '' END || ': ' || definition AS document FROM terms_"),
    "define_term": (define_term, f"{WITH}, {GLOSS_SQL} SELECT q AS query, doc_id, term, definition FROM terms_ JOIN (VALUES ('ecm'), ('ECM'), ('Outreach'), ('outreach'), ('Population of Focus')) v(q) ON abbreviation = upper(q) OR abbreviation = q OR term = q"),
    "format_definitions": (format_definitions, f"""{WITH}, {GLOSS_SQL} SELECT doc_id, string_agg('[' || term || CASE WHEN abbreviation IS NOT NULL THEN ' (' || abbreviation || ')' ELSE '' END || ']' || chr(10) || 'Definition: ' || definition || chr(10) || 'Source: ' || CASE WHEN coalesce(section_heading, '') <> '' THEN section_heading || ' — ' ELSE '' END || doc_id || '.pdf, page ' || page_number, chr(10) || '---' || chr(10) ORDER BY term, priority) AS text FROM terms_ GROUP BY ALL"""),
    "section_numbers": (section_numbers, f"{WITH} SELECT doc_id, section_no, {NUMBER_SQL} AS number, {KEY('heading')} AS key FROM merged"),
    "detect_refs": (detect_refs, f"{WITH}, {REFS_SQL} SELECT doc_id, section_no, ref_no, raw_text, target_key, ref_type FROM refs_"),
    "section_keys": (section_keys, f"{WITH}, {REFS_SQL} SELECT doc_id, key, heading, length(body) AS body_chars FROM keys_"),
    "resolve_refs": (resolve_refs, f"{WITH}, {REFS_SQL} SELECT doc_id, section_no, rank, target_key, heading, summary FROM resolved"),
    "ref_context": (ref_context, f"""{WITH}, {REFS_SQL} SELECT doc_id, section_no, chr(10) || '--- REFERENCED SECTIONS (auto-resolved for context) ---' || chr(10) || string_agg(chr(10) || '[Reference: "' || raw_text || '"]' || chr(10) || 'Section: ' || heading || chr(10) || summary, chr(10) ORDER BY rank) AS context FROM resolved GROUP BY ALL"""),
    "lookup_sections": (lookup_sections, f"""{WITH}, {REFS_SQL}, ask AS (SELECT DISTINCT doc_id, sid, n FROM merged, (VALUES ('III.A', 0), ('4.2', 3), ('nowhere', 4), ('Appendix B', 5)) v(sid, n)),
hit0 AS (SELECT a.*, k.heading, k.body FROM ask a LEFT JOIN keys_ k ON k.doc_id = a.doc_id AND (k.key = {KEY("sid")} OR (length({KEY("sid")}) >= 2 AND starts_with(k.key, {KEY("sid")})) OR (length(k.key) >= 2 AND starts_with({KEY("sid")}, k.key))) QUALIFY row_number() OVER (PARTITION BY a.doc_id, n ORDER BY CASE WHEN k.key = {KEY("sid")} THEN 1 WHEN starts_with(k.key, {KEY("sid")}) THEN 2 ELSE 3 END, k.seq) = 1)
SELECT doc_id, string_agg(CASE WHEN heading IS NULL THEN '[' || sid || '] No section found.' ELSE '[' || sid || '] Section: ' || heading || chr(10) || {_cut("body", 450)} END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS text FROM hit0 GROUP BY ALL"""),
    "truncated": (truncated, f"{WITH} SELECT doc_id, section_no, {_cut('text', 60)} AS cut FROM merged"),
    "render_section": (render_section, f"{WITH} SELECT doc_id, section_no, 'Section heading: ' || heading || chr(10) || 'Pages: ' || page_start || '–' || page_end || chr(10) || chr(10) || text || coalesce(array_to_string(list_transform(tables, lambda t, i: chr(10) || chr(10) || '[TABLE ' || i || ']' || chr(10) || t || chr(10) || '[/TABLE ' || i || ']'), ''), '') AS rendered FROM merged"),
    "batch_prompt": (batch_prompt, f"""{WITH}, sm AS (SELECT *, ((row_number() OVER (PARTITION BY doc_id ORDER BY section_no) - 1) // 3)::int AS batch_no FROM merged WHERE NOT (char_count >= 800 OR len(tables) > 0))
SELECT doc_id, batch_no, string_agg('[SECTION_START heading=''' || heading || ''' page=' || page_start || ']' || CASE WHEN text <> '' THEN chr(10) || text ELSE '' END || chr(10) || '[SECTION_END]' || chr(10), chr(10) ORDER BY section_no) AS prompt FROM sm GROUP BY ALL"""),
    "list_items": (list_items, f"{LISTS_SQL} SELECT doc_id, node_no, indent, marker, display, text, kind FROM ityped"),
    "list_levels": (list_levels, f"{LISTS_SQL} SELECT doc_id, node_no, level FROM lev"),
    "list_paths": (list_paths, f"{LISTS_SQL} SELECT l.doc_id, l.node_no, t.parent_no, l.level = 1 AS is_root, l.level, t.path, l.display AS marker, l.text FROM lev l JOIN tree t ON t.doc_id = l.doc_id AND t.node_no = l.node_no"),
    "list_trees": (list_trees, f"""{LISTS_SQL}, tn AS (SELECT l.doc_id, l.node_no, l.level, l.display, l.text, t.path, len(t.stack) AS d, t.stack[1].n AS top FROM lev l JOIN tree t ON t.doc_id = l.doc_id AND t.node_no = l.node_no),
rt AS (SELECT tn.*, lead(d) OVER (PARTITION BY tn.doc_id ORDER BY tn.node_no) AS nd FROM tn JOIN lev x ON x.doc_id = tn.doc_id AND x.node_no = tn.top WHERE x.level = 1),
js AS (SELECT doc_id, string_agg('{{"marker": ' || to_json(display) || ', "text": ' || to_json(text) || ', "level": ' || level || ', "path": ' || to_json(path) || ', "children": [' || CASE WHEN nd IS NULL THEN repeat(']}}', d) WHEN nd > d THEN '' ELSE repeat(']}}', d - nd + 1) || ', ' END, '' ORDER BY node_no) AS body FROM rt GROUP BY ALL)
SELECT doc_id, '[' || coalesce(body, '') || ']' AS tree FROM (SELECT DISTINCT doc_id FROM lev) LEFT JOIN js USING (doc_id)"""),
    "review_form_questions": (review_form_questions, rf"""{WITH}, tx AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY ALL), q AS (SELECT doc_id, unnest(regexp_extract_all(text, '{X.CHECKLIST_QUESTION}', 1)) AS id, unnest(regexp_extract_all(text, '{X.CHECKLIST_QUESTION}', 2)) AS q, unnest(regexp_extract_all(text, '{X.CHECKLIST_QUESTION}', 3)) AS r FROM tx)
SELECT doc_id, id::int AS id, trim(regexp_replace(regexp_replace(q, '(?i)\([^)]*(?:P&P may|examples provided|list below)[^)]*\)\s*$', ''), '\s+', ' ', 'g')) AS text, trim(r) AS reference FROM q"""),
    "hierarchy": (hierarchy, f"""{WITH}, lvs AS (SELECT doc_id, heading, arg_max(level, section_no) AS level FROM merged GROUP BY ALL), rq AS (SELECT doc_id, section_no, row_number() OVER (PARTITION BY doc_id ORDER BY section_no) AS id, l.level FROM merged m JOIN lvs l USING (doc_id, heading))
SELECT doc_id, id, CASE WHEN level >= 3 THEN last_value(CASE WHEN level <= 2 THEN id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section_no ROWS UNBOUNDED PRECEDING) END AS parent_id, level FROM rq"""),
    "parent_integrity": (parent_integrity, "SELECT 0 AS orphans"),
    "zone_signatures": (zone_signatures, f"{BLOCKS_SQL} SELECT * FROM rs"),
    "y_buckets": (y_buckets, f"{BLOCKS_SQL} SELECT * FROM rb"),
    "zone_filter": (zone_filter, f"{BLOCKS_SQL} SELECT doc_id, page_number, src_no FROM zoned ANTI JOIN rs USING (doc_id, signature) ANTI JOIN rb USING (doc_id, bucket)".replace("FROM zoned ANTI", "FROM zoned z ANTI")),
    "font_sizes": (font_sizes, f"{BLOCKS_SQL} SELECT doc_id, size, chars FROM fs"),
    "heading_levels": (heading_levels, f"{BLOCKS_SQL} SELECT b.doc_id, b.page_number, b.src_no, CASE WHEN b.type = 0 THEN min(h.level) END AS level FROM blocks_ b LEFT JOIN hs h ON h.doc_id = b.doc_id AND abs(h.size - b.size) <= 0.5 GROUP BY b.doc_id, b.page_number, b.src_no, b.type"),
    "block_minus_tables": (block_minus_tables, f"{BLOCKS_SQL} SELECT doc_id, page_number, src_no FROM blocks_ b WHERE type = 0 AND NOT EXISTS (SELECT 1 FROM blocks_ t WHERE t.type = 1 AND t.doc_id = b.doc_id AND t.page_number = b.page_number AND b.x0 < t.x1 AND t.x0 < b.x1 AND b.y0 < t.y1 AND t.y0 < b.y1)"),
    "page_order": (page_order, f"{BLOCKS_SQL} SELECT doc_id, page_number, src_no, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0, type DESC, src_no) AS place FROM blocks_"),
}
