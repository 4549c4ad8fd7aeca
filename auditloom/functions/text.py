"""Scalar text functions as columns: everything stays in JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode has it, with the four ASCII separators; also what trimming takes off.
TRIMMED = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{TRIMMED}]"
#: Line breaks, a pair of carriage return and line feed counting as one.
BREAK = "\r\n|[\n\x0b\f\r\x1c\x1d\x1e\x85\u2028\u2029]"

# Phrase groups that mark an obligation.
OBLIGATION_GROUPS = {
    "duty": r"(?i)\b(?:must|shall|required to|is responsible for)\b",
    "prohibition": r"(?i)\b(?:prohibited|may not|must not|shall not)\b",
    "expectation": r"(?i)\b(?:should|expected to|is expected)\b",
    "deadline": r"(?i)\b(?:within \d+ (?:days|business days|calendar days))\b",
    "frequency": r"(?i)\b(?:annually|quarterly|monthly|upon request|no later than)\b",
    "conformity": r"(?i)\b(?:comply with|in accordance with|pursuant to)\b",
    "programme": r"(?i)\b(?:ensure that|maintain|establish|implement|develop)\b",
}
# Roman numerals that a list may use.
LOWER_ROMAN = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx xxi xxii xxiii xxiv xxv".split()
# Needles of transient errors, of the extractor (upper-cased) and of the question agent (as they are).
TRANSIENT = ("503", "429", "UNAVAILABLE", "RESOURCE_EXHAUSTED", "HIGH DEMAND", "RATE LIMIT", "QUOTA")
TRANSIENT_AGENT = ("503", "UNAVAILABLE", "high demand")


#: White space but the blank itself, as few ranges: a long list of single characters is slow to search for.
RARE_SPACE = "[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def wide(pattern: str) -> str:
    """A pattern whose \\s stands for all white space, in and outside of character classes."""
    return pattern.replace(r"\s", SPACE)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(TRIMMED))


def blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def non_blank_parts(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")


def sentences(c: Column) -> Column:
    """cut after . ! ? before white space; trimmed, without empties."""
    return non_blank_parts(c, rf"(?<=[.!?]){SPACE}+")


def paragraphs(c: Column) -> Column:
    """cut at two or more line breaks; trimmed, without empties."""
    return non_blank_parts(c, "\n\n+")


def folder_of(path: Column) -> Column:
    """the first path segment, or nothing."""
    return F.when(F.instr(path, "/") > 0, F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.lit(""))


def tail_of(c: Column, n: int) -> Column:
    """the last n characters."""
    return F.right(c, F.lit(n)) if n > 0 else F.lit("")


def signature(c: Column) -> Column:
    """lower-cased text with digit runs as # and single spaces; empty if only punctuation is left."""
    plain = let(F.regexp_replace(F.lower(strip(c)), r"\d+", "#"), lambda s: F.when(s.rlike(RARE_SPACE), F.regexp_replace(s, RARE_SPACE, " ")).otherwise(s))
    single = let(plain, lambda s: F.when(F.contains(s, F.lit("  ")), F.regexp_replace(s, " {2,}", " ")).otherwise(s))
    return let(single, lambda s: F.when(s.rlike(r"^[#.,|\-/\\ ]*$"), F.lit("")).otherwise(s))


def y_bucket(y: Column) -> Column:
    """the nearest multiple of 0.025, halves to even, to four places."""
    return F.bround(F.bround(y / 0.025) * 0.025, 4)


def block_text(lines: Column) -> Column:
    """span texts that are not blank, joined without separator, stripped."""
    spans = F.flatten(F.transform(lines, lambda line: F.transform(line["spans"], lambda s: s["text"])))
    return strip(F.array_join(F.filter(spans, lambda t: strip(t) != ""), ""))


def pipe_row(cells: Column) -> Column:
    """cells as pipe text; null cells are empty."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: strip(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))


def overlaps(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """whether two rectangles share area."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def obligation_classes(c: Column) -> dict[str, Column]:
    return {name: c.rlike(p) for name, p in OBLIGATION_GROUPS.items()}


def has_obligation(c: Column) -> Column:
    """any of the phrase groups."""
    return c.rlike("|".join(OBLIGATION_GROUPS.values()))


def marker_type(m: Column) -> Column:
    """what kind of list marker."""
    return (
        F.when(m.rlike(r"^[0-9]+$"), "decimal")
        .when(m.isin(*LOWER_ROMAN), "lower_roman")
        .when(m.rlike("^[a-z]$"), "lower_alpha")
        .when(m.rlike("^[A-Z]$"), "upper_alpha")
        .otherwise("unknown")
    )


# A list line's indent, parenthesised marker, bare marker, its delimiter, body.
_MARKER = r"\d{1,3}|[A-Za-z]|" + "|".join(sorted((r for r in LOWER_ROMAN if len(r) > 1), key=lambda r: (-len(r), r)))
LIST_LINE = rf"^([ \t]*)(?:\(({_MARKER})\)[ \t]+|({_MARKER})([.)])[ \t]+)(\S.*)$"


def _columns_of(indent: Column) -> Column:
    """The width of an indent; a tab goes to the next multiple of four."""
    stops = F.aggregate(F.split(indent, ""), F.lit(0), lambda n, c: F.when(c == "\t", n - n % 4 + 4).otherwise(n + F.length(c)))
    return F.when(F.contains(indent, F.lit("\t")), stops).otherwise(F.length(indent))


def list_item(line: Column) -> dict[str, Column]:
    """indent, marker, display form and body of a list line; marker is empty on other lines."""
    part = lambda i: F.regexp_extract(line, LIST_LINE, i)
    marker = F.when(part(2) != "", part(2)).otherwise(part(3))
    shown = F.when(part(2) != "", F.concat(F.lit("("), part(2), F.lit(")"))).otherwise(F.concat(part(3), part(4)))
    return {"indent": _columns_of(part(1)), "marker": marker, "display": shown, "body": strip(part(5))}


# What a section identifier looks like.
IDENTIFIER = r"[A-Z0-9][A-Z0-9]*(?:[.\-][A-Z0-9a-z]+)*\.?"
# How a heading gives its number, in order of priority.
NUMBERED = (
    r"^(?i:Appendix|Annex|Exhibit)\s+([A-Za-z0-9]+)",
    rf"(?i)^Section\s+({IDENTIFIER})",
    r"^([IVXLCDM]+(?:\.[A-Z0-9]+)*\.?)\s+\S",
    r"^(\d+(?:\.\d+)+)\.?\s+\S",
    r"^([A-Z])\.\s+\S",
)


def section_number(heading: Column) -> Column:
    """the identifier that a heading starts with, or null."""
    h = strip(heading)
    found = lambda p: F.nullif(F.regexp_extract(h, wide(p), 1), F.lit(""))
    bare = lambda c: F.rtrim(c, F.lit("."))
    name, section, roman, dotted, letter = (found(p) for p in NUMBERED)
    return F.coalesce(F.upper(name), bare(section), bare(roman), dotted, letter)


def normal_key(c: Column) -> Column:
    """F16: trimmed, lower-cased, without closing punctuation, single spaces."""
    return F.regexp_replace(F.rtrim(F.lower(strip(c)), F.lit(".,;")), rf"{SPACE}+", " ")


def truncate(c: Column, n: int) -> Column:
    """at most n characters, back to the last sentence end past n / 2, with an ellipsis."""

    def cut(text: Column) -> Column:
        head = F.substring(text, 1, n)
        # 0-based place of the last ". " in the head, -1 if none
        last = F.when(F.locate(" .", F.reverse(head)) > 0, F.length(head) - F.locate(" .", F.reverse(head)) - 1).otherwise(-1)
        return F.when(F.length(text) <= n, text).otherwise(F.concat(strip(let(last, lambda k: F.when(k > n // 2, head.substr(F.lit(1), k + 1)).otherwise(head))), F.lit(" …")))

    return let(strip(c), cut)


def initials_match(phrase: Column, acronym: Column) -> Column:
    """the acronym's characters come in order among the initials of the phrase's words."""
    words = F.filter(F.split(strip(phrase), wide(r"[\s/&\-]+")), lambda w: w != "")
    initials = F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")
    letters = F.regexp_replace(F.upper(acronym), "[^A-Z0-9]", "")
    pattern = F.array_join(F.filter(F.split(letters, ""), lambda x: x != ""), ".*")
    return (letters != "") & (initials != "") & F.regexp_like(initials, pattern)


def table_cells(line: Column) -> Column:
    """trimmed cells of a pipe line; empty cells are dropped, so columns shift left."""
    return non_blank_parts(line, r"\|")


def table_lines(table: Column) -> Column:
    return non_blank_parts(table, "\n")


def table_header(table: Column) -> Column:
    return F.transform(table_cells(F.get(table_lines(table), F.lit(0))), F.lower)


def _mentions(h: Column, words: tuple[str, ...]) -> Column:
    return h.rlike("|".join(words))


def is_definition_table(header: Column) -> Column:
    """the header names definitions."""
    return _mentions(F.array_join(header, " "), ("definition", "criteria", "meaning"))


def column_index(header: Column, words: tuple[str, ...], fallback: int) -> Column:
    """0-based place of the first header with one of the words."""
    at = F.array_position(F.transform(header, lambda h: _mentions(h, words)), F.lit(True))
    return F.when(at > 0, at - 1).otherwise(fallback).cast("int")


# Patterns of glossary lines and headings, inline acronyms, checklist questions and their notes.
GLOSSARY_LINE = r"(?m)^[-\u2022*]?\s*([A-Z][^\n:\u2014\-]{1,80}?)\s*(?:[:\u2014\-]\s*)(.{10,}?)$"
INLINE_ACRONYM = r"([A-Z][A-Za-z0-9&/\- ]{2,80}?)\s*\(([A-Z][A-Z0-9/&\-]{1,10})\)"
GLOSSARY_HEADING = r"(?i)^(?:appendix\s+[a-z]:\s*)?(definitions?|glossary|abbreviations?|acronyms?|key\s+terms?)\b"
CHECKLIST_QUESTION = r"(?is)(\d+)\.\s+(Does the P&P\b.+?)\(Reference:\s*(APL\s+[\d-]+,\s*(?:[^()]*|\([^)]*\))*)\)"
EDITORIAL_NOTE = r"(?i)\([^)]*(?:P&P may|examples provided|list below)[^)]*\)\s*$"


def is_glossary_heading(heading: Column) -> Column:
    """F24."""
    return heading.rlike(wide(GLOSSARY_HEADING))


def clean_question(c: Column) -> Column:
    """without a closing editorial note, white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(c, wide(EDITORIAL_NOTE), ""), rf"{SPACE}+", " "))


def is_checklist(c: Column) -> Column:
    """some line is a numbered checklist question."""
    return c.rlike(wide(r"(?im)^\d+\.\s+Does the P&P\b"))


def drop_nulls(m: Column) -> Column:
    """F25."""
    return F.map_filter(m, lambda _, v: v.isNotNull())


def coerced_int(c: Column, default: int = 0) -> Column:
    """an integer as it stands; anything else is the default."""
    return F.coalesce(F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), strip(c).try_cast("int")), F.lit(default))


def coerced_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(strip(c).try_cast("double"), F.lit(default))


def coerced_text(c: Column, default: str = "") -> Column:
    return F.coalesce(c, F.lit(default))


def transient(message: Column) -> Column:
    """F34, the extractor's test."""
    return F.upper(message).rlike("|".join(TRANSIENT))


def transient_agent(message: Column) -> Column:
    """F34, the question agent's test: case counts."""
    return message.rlike("|".join(TRANSIENT_AGENT))


def completeness(optional: list[Column], text: Column) -> Column:
    """filled optional fields plus the length of the text."""
    filled = F.lit(0)
    for c in optional:
        filled = filled + c.isNotNull().cast("int")
    return filled + F.length(text)


def similarity(distance: Column, floor: bool = False) -> Column:
    """F36."""
    return F.greatest(F.lit(0.0), 1 - distance) if floor else 1 - distance


def result_text(rank: Column, score: Column, source: Column, page: Column, text: Column) -> Column:
    """one search result."""
    # format_number rounds the exact binary value; format_string would round its decimal text
    return F.format_string("[Result %d] Score: %s\nSource: %s, Page %d\nText: %s\n", rank, F.format_number(score, 3), source, page, text)


def definition_text(term: Column, abbreviation: Column, definition: Column, source_file: Column, page: Column, heading: Column) -> Column:
    """one definition."""
    abbr = F.when(F.coalesce(abbreviation, F.lit("")) != "", F.concat(F.lit(" ("), abbreviation, F.lit(")"))).otherwise("")
    place = F.concat(F.coalesce(source_file, F.lit("")), F.lit(", page "), F.coalesce(page.cast("string"), F.lit("?")))
    source = F.when(F.coalesce(heading, F.lit("")) != "", F.concat(heading, F.lit(" — "), place)).otherwise(place)
    return F.concat(F.lit("["), term, abbr, F.lit("]\nDefinition: "), definition, F.lit("\nSource: "), source)


def _numbered(tables: Column, before: str = "") -> Column:
    return F.transform(tables, lambda t, i: F.format_string(before + "[TABLE %d]\n%s\n[/TABLE %d]", i + 1, t, i + 1))


def section_text(heading: Column, page_start: Column, page_end: Column, text: Column, tables: Column) -> Column:
    """a section as its reader sees it: heading, page range, text and numbered tables."""
    head = F.format_string("Section heading: %s\nPages: %d–%d\n\n%s", heading, page_start, page_end, text)
    return F.concat(head, F.array_join(F.transform(_numbered(tables, "\n"), lambda t: F.concat(F.lit("\n"), t)), ""))


def batch_entry(heading: Column, page_start: Column, text: Column, tables: Column) -> Column:
    """a section inside a batch prompt."""
    mark = F.format_string("[SECTION_START heading='%s' page=%d]", heading, page_start)
    return F.concat_ws("\n", mark, F.nullif(strip(text), F.lit("")), F.when(F.size(tables) > 0, F.array_join(_numbered(tables), "\n")), F.lit("[SECTION_END]\n"))


def tagged_hash(*parts: Column) -> Column:
    """SHA-256 over parts set apart by NUL."""
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def confidence_tier(confidence: Column, flagged: Column) -> Column:
    """F43."""
    return F.when(flagged | (confidence < 0.5), "red").when(confidence < 0.8, "yellow").otherwise("green")


def progress_percent(done: Column, total: Column) -> Column:
    """rounded half up; 0 of nothing is 0."""
    return F.when(total > 0, F.floor(100 * done / total + 0.5)).otherwise(0).cast("int")


def critic_suffix(reasoning: Column, reason: Column, changed: Column) -> Column:
    """F47."""
    return F.when(changed, F.concat(reasoning, F.lit(" [Critic: "), F.coalesce(reason, F.lit("")), F.lit("]"))).otherwise(reasoning)
