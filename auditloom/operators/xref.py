"""Cross references: detection, the section index, and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import settle
from .lines import joined
from .terms import _first

MAX_CHARS, MAX_REFS = 450, 6
# Fixed value: what stands before the referenced sections.
CONTEXT_HEAD = "\n--- REFERENCED SECTIONS (auto-resolved for context) ---\n"

# The reference patterns in order of priority; group 1 is the target.
_ID = X.IDENTIFIER
PATTERNS = (
    ("section", rf"(?i)\bsee\s+(?:Sections?|Appendix|Appendices|Annex(?:es)?|Article|Exhibit)\s+({_ID})"),
    ("section", rf"(?i)\bas\s+(?:defined|described|noted|required|specified|set\s+forth)\s+in\s+(?:Sections?|Appendix|Annex|Article|Exhibit)\s+({_ID})"),
    ("section", rf"(?i)\b(?:per|pursuant\s+to|under|in\s+accordance\s+with)\s+(?:Section|Appendix|Annex|Article)\s+({_ID})"),
    ("section", rf"(?i)\brequirements?\s+(?:of|in|set\s+forth\s+in)\s+(?:Section|Appendix|Annex)?\s*({_ID})"),
    ("cfr", r"(?i)\b(\d+\s+C\.?F\.?R\.?\s*§\s*[\d.]+(?:\([a-z0-9]+\))*)"),
    ("section", rf"(?im)(?:^|[\s,(;])(?:Section|Appendix|Annex|Exhibit)\s+({_ID})(?=[\s,.);\n]|$)"),
)


def detect(sections: DataFrame) -> DataFrame:
    """references (doc_id, section_no, ref_no, raw_text, target_key, ref_type), by pattern, then place.

    One per normalised target of a section.
    """

    def matches(n: int, kind: str, p: str) -> Column:
        p = X.wide(p)
        both = F.arrays_zip(F.expr(f"regexp_extract_all(text, r'{p}', 0)").alias("raw"), F.expr(f"regexp_extract_all(text, r'{p}', 1)").alias("target"))
        return F.transform(both, lambda m, i: F.struct(F.lit(n).alias("p"), i.alias("i"), X.strip(m["raw"]).alias("raw_text"), F.rtrim(X.strip(m["target"]), F.lit(".")).alias("target_key"), F.lit(kind).alias("kind")))

    found = [matches(n, kind, p) for n, (kind, p) in enumerate(PATTERNS)]
    df = sections.select("doc_id", "section_no", F.inline(F.concat(*found))).withColumn("norm", X.normal_key(F.col("target_key")))
    df = _first(df, ["doc_id", "section_no", "norm"], ["p", "i"])
    kind = F.when(F.col("target_key").rlike("(?i)^[A-Z]$"), "appendix").otherwise(F.col("kind"))
    number = F.row_number().over(Window.partitionBy("doc_id", "section_no").orderBy("p", "i"))
    return df.select("doc_id", "section_no", number.alias("ref_no"), "raw_text", "target_key", "norm", kind.alias("ref_type"))


def index(sections: DataFrame) -> DataFrame:
    """(doc_id, key, seq, heading, body): up to four keys a section, the first of equal keys stays."""
    number = X.section_number(F.col("heading"))
    bare = F.regexp_replace(number, r"(?i)^(?:appendix|annex|exhibit)\s*", "")
    rest = X.strip(F.regexp_replace("heading", X.wide(r"(?i)^[IVXLCDM0-9][A-Z0-9.\-]*\.?\s+"), ""))
    keys = F.array(F.col("heading"), number, bare, F.when((rest != "") & (rest != F.col("heading")), rest))
    body = X.strip(F.concat(X.strip(F.col("text")), F.when(F.size("tables") > 0, F.concat(F.lit("\n"), F.array_join("tables", "\n"))).otherwise("")))
    df = sections.select("doc_id", "section_no", "heading", body.alias("body"), F.posexplode(keys).alias("k", "raw")).withColumn("key", X.normal_key(F.col("raw")))
    df = _first(df.where("key <> ''"), ["doc_id", "key"], ["section_no", "k"])
    return df.select("doc_id", "key", (F.col("section_no") * 4 + F.col("k")).alias("seq"), "heading", "body")


def resolve(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """Asked (doc_id, norm, ...) with heading and body of the best key, null if none.

    Exact key, else the first stored key that begins with the query, else the
    first stored key that the query begins with; the latter two need two
    characters.  The theta parts are equi-joins: every prefix of the longer side
    is written out, and keys are short.
    """
    q = asked.select("doc_id", "norm").where("norm <> ''").distinct()
    prefixes = lambda c: F.transform(F.sequence(F.lit(2), F.length(c)), lambda n: c.substr(F.lit(1), n))
    exact = q.join(keys.select("doc_id", F.col("key").alias("norm"), "seq", "heading", "body"), ["doc_id", "norm"]).withColumn("rule", F.lit(1))
    longer = keys.where("length(key) >= 2").select("doc_id", "seq", "heading", "body", F.explode(prefixes(F.col("key"))).alias("norm"))
    stored = q.join(longer, ["doc_id", "norm"]).select("doc_id", "norm", "seq", "heading", "body").withColumn("rule", F.lit(2))
    asked_prefix = q.where("length(norm) >= 2").select("doc_id", "norm", F.explode(prefixes(F.col("norm"))).alias("key"))
    query = asked_prefix.join(keys.where("length(key) >= 2"), ["doc_id", "key"]).select("doc_id", "norm", "seq", "heading", "body").withColumn("rule", F.lit(3))
    best = _first(exact.unionByName(stored).unionByName(query), ["doc_id", "norm"], ["rule", "seq"]).drop("seq", "rule")
    return asked.join(best, ["doc_id", "norm"], "left")


def resolve_sections(sections: DataFrame, max_chars: int = MAX_CHARS, max_refs: int = MAX_REFS) -> DataFrame:
    """Per section, up to max_refs references that resolve to another section with a text."""
    sections = settle(sections, "sections")  # read for the references, the index and the headings
    own = sections.select("doc_id", "section_no", F.col("heading").alias("own_heading"))
    df = resolve(detect(sections).where("ref_type <> 'cfr'"), index(sections)).where("heading IS NOT NULL").join(own, ["doc_id", "section_no"])
    df = df.where((F.col("own_heading") == "") | (X.normal_key(F.col("heading")) != X.normal_key(F.col("own_heading")))).withColumn("summary", X.truncate(F.col("body"), max_chars)).where("summary <> ''")
    rank = F.row_number().over(Window.partitionBy("doc_id", "section_no").orderBy("ref_no"))
    return df.withColumn("rank", rank).where(F.col("rank") <= max_refs).select("doc_id", "section_no", "rank", "raw_text", "target_key", "ref_type", "heading", "summary")


def context(resolved: DataFrame) -> DataFrame:
    """the resolved references of a section as one text."""
    part = F.format_string('\n[Reference: "%s"]\nSection: %s\n%s', "raw_text", "heading", "summary")
    return resolved.withColumn("_p", part).groupBy("doc_id", "section_no").agg(F.concat(F.lit(CONTEXT_HEAD), joined("rank", "_p", "\n")).alias("context"))


def lookup(asked: DataFrame, keys: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """asked (doc_id, request_no, id_no, section_id) to one text per request.

    Blank ids and those seen before, whatever their case, are left out.
    """
    ids = asked.withColumn("sid", X.strip(F.col("section_id"))).where("sid <> ''").withColumn("low", F.lower("sid"))
    ids = _first(ids, ["doc_id", "request_no", "low"], ["id_no"]).withColumn("norm", X.normal_key(F.col("sid")))
    found = resolve(ids, keys)
    text = F.when(F.col("heading").isNull(), F.format_string("[%s] No section found.", "sid")).otherwise(F.format_string("[%s] Section: %s\n%s", "sid", "heading", X.truncate(F.col("body"), max_chars)))
    every = asked.select("doc_id", "request_no").distinct()
    made = found.withColumn("_t", text).groupBy("doc_id", "request_no").agg(joined("id_no", "_t", "\n\n---\n\n").alias("text"))
    return every.join(made, ["doc_id", "request_no"], "left").withColumn("text", F.coalesce("text", F.lit("No valid section identifiers provided.")))
