"""Model answers in JSON, parsed with built-in functions; bad rows become null, fallback or status rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ANSWERS
from . import text as X

REQUIREMENTS = "array<struct<id:string,text:string,reference:string,category:string>>"
COMPLIANCE = "array<struct<text:string,reference:string,category:string,obligation_type:string,obligation_level:string,actor:string,action_required:string,condition:string,timeframe:string,evidence_needed:string,risk_area:string,exact_quote:string,section_heading:string>>"
#: So many sections of batches may be broadcast: some MB.
BROADCAST_SECTIONS = 20_000
#: JSON values that do not set a flag.
FALSE = ("null", "false", "0", "0.0", '""', "[]", "{}")


def unfenced(raw: Column) -> Column:
    """The inside of a code fence that the text begins with; else the text."""

    def inner(t: Column) -> Column:
        lines = F.split(t, "\n", -1)
        rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
        closed = X.strip(F.coalesce(F.element_at(rest, -1), F.lit(""))) == "```"
        body = F.when(F.size(rest) == 0, F.lit("")).otherwise(F.array_join(F.when(closed, F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest), "\n"))
        return F.when(t.startswith("```"), X.strip(body)).otherwise(t)

    return X.let(X.strip(raw), inner)


def _is_array(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("ARRAY"), F.lit(False))


def outermost(raw: Column, opening: str, closing: str) -> Column:
    """The longest stretch from the first opening to the last closing bracket, else the text."""
    found = F.regexp_extract(raw, rf"(?s)\{opening}.*\{closing}", 0)
    return F.when(found != "", found).otherwise(raw)


def _items(text: Column, schema: str) -> Column:
    """The elements of a JSON array, each read on its own, so a bad one does not spoil the others."""
    element = schema.removeprefix("array<").removesuffix(">")
    return F.transform(F.from_json(text, "array<string>"), lambda x: F.from_json(x, element))


def requirements(df: DataFrame, raw: str = "raw") -> DataFrame:
    """(…, status, id, text, reference, category): one row per good item.

    status is ok, not_json or not_array; of the latter two one row without an
    item stays.  Items without a whole id or a text are left out.
    """
    text = outermost(unfenced(F.col(raw)), "[", "]")
    keep = [c for c in df.columns if c != raw]
    parsed = df.withColumn("_t", text).withColumn("status", F.when(F.try_parse_json("_t").isNull(), "not_json").when(~_is_array(F.col("_t")), "not_array").otherwise("ok"))
    parsed = parsed.withColumn("_i", F.when(F.col("status") == "ok", _items(F.col("_t"), REQUIREMENTS)))
    good = F.filter("_i", lambda x: x["id"].rlike(r"^[+-]?\d+$") & x["text"].isNotNull())
    rows = parsed.select(*keep, "status", F.posexplode_outer(good).alias("item_no", "r")).where("status <> 'ok' OR r IS NOT NULL")
    return rows.select(*keep, "status", "item_no", F.col("r.id").cast("int").alias("id"), F.col("r.text").alias("text"), F.col("r.reference").alias("reference"), F.col("r.category").alias("category"))


def compliance(df: DataFrame, raw: str = "raw", heading: str = "section_heading") -> DataFrame:
    """as requirements(), but anything unreadable gives no rows; id 0, no parent, default heading."""
    text = outermost(unfenced(F.col(raw)), "[", "]")
    items = F.when(_is_array(text), _items(text, COMPLIANCE))
    keep = [c for c in df.columns if c not in (raw, heading)]
    rows = df.select(*keep, F.col(heading).alias("_h"), F.posexplode(items).alias("item_no", "r")).where("r.text IS NOT NULL")
    fields = [c for c in ("text", "reference", "category", "obligation_type", "obligation_level", "actor", "action_required", "condition", "timeframe", "evidence_needed", "risk_area", "exact_quote")]
    return rows.select(*keep, "item_no", F.lit(0).alias("id"), *(F.col(f"r.{c}").alias(c) for c in fields), F.lit(None).cast("int").alias("parent_id"), F.coalesce("r.section_heading", "_h").alias("section_heading"))


def batch(df: DataFrame, sections: DataFrame, raw: str = "raw") -> DataFrame:
    """{sections: [{heading, requirements}]} to rows with the section each belongs to.

    sections has (batch_no, section_no, heading).  The same heading counts, else
    the first that contains the given one or is contained in it; case counts.  Of
    sections with equal headings the last is meant.  A batch has few sections, so
    its headings ride along as an array; where all of them may be broadcast, answers
    stay where they are, however few batches they belong to.  An answer is read
    and matched in one expression, so nothing of it is computed twice.
    """
    place = F.struct("section_no", "heading")
    known = sections.where("heading IS NOT NULL").groupBy("batch_no", "heading").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    known = known.groupBy("batch_no").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("_s"))
    known = F.broadcast(known) if sections.count() <= BROADCAST_SECTIONS else known
    schema = f"struct<sections:array<struct<heading:string,requirements:{COMPLIANCE}>>>"

    def meant(given: Column) -> Column:
        same = F.filter("_s", lambda s: s["last"]["heading"] == given)
        near = F.filter("_s", lambda s: (given != "") & (F.contains(s["last"]["heading"], given) | F.contains(given, s["last"]["heading"])))
        return F.coalesce(F.get(same, F.lit(0)), F.get(near, F.lit(0)))["last"]

    def found(answer: Column, n: Column) -> Column:
        row = lambda m: lambda r, i: F.struct(n.alias("answer_no"), i.alias("item_no"), m["section_no"].alias("section_no"), m["heading"].alias("section_heading"), r["text"].alias("text"), r["actor"].alias("actor"), r["timeframe"].alias("timeframe"))
        return X.let(X.let(X.strip(F.coalesce(answer["heading"], F.lit(""))), meant), lambda m: F.when(m.isNotNull(), F.transform(answer["requirements"], row(m))))

    text = X.let(unfenced(F.col(raw)), lambda t: outermost(t, "{", "}"))
    made = X.let(F.from_json(text, schema)["sections"], lambda s: F.flatten(F.filter(F.transform(s, found), lambda x: x.isNotNull())))
    return df.join(known, "batch_no").select("batch_no", F.inline(F.filter(made, lambda x: x["text"].isNotNull())))


def verdicts(df: DataFrame, raw: str = "raw") -> DataFrame:
    """critic verdicts from a list, a fenced list, a list inside an object, or the first shortest [...]; else none.

    An id that is no number names nothing and is null.  Any text but the empty one sets the flag.
    """
    fence = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    text = X.strip(F.when(F.col(raw).rlike(r"(?s)```(?:json)?\s*.*?```"), fence).otherwise(F.col(raw)))
    df = df.withColumn("_t", text).withColumn("_v", F.try_parse_json("_t"))
    first_list = F.regexp_extract(F.col("_t"), r"(?s)\[.*?\]", 0)
    wrapped = F.map_values(F.from_json("_t", "map<string,string>"))
    in_object = F.get(F.filter(wrapped, lambda x: x.startswith("[")), F.lit(0))
    listed = F.when(_is_array(F.col("_t")), F.col("_t")).when(F.col("_v").isNotNull() & in_object.isNotNull(), in_object).when(_is_array(first_list), first_list)
    keep = [c for c in df.columns if c not in (raw, "_t", "_v")]
    rows = df.select(*keep, F.posexplode(F.from_json(listed, "array<string>")).alias("seq", "_x")).withColumn("_x", F.try_parse_json("_x"))
    field = lambda f: F.try_variant_get("_x", f"$.{f}", "variant")
    number = F.when(F.schema_of_variant(field("requirement_id")).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get("_x", "$.requirement_id", "double"))
    whole = F.when(number == F.floor(number), number.try_cast("int"))
    flag = F.coalesce(~F.to_json(field("needs_human_review")).isin(*FALSE), F.lit(False))
    text = lambda f: F.try_variant_get("_x", f"$.{f}", "string")
    rows = rows.where(F.schema_of_variant("_x").startswith("OBJECT"))
    return rows.select(*keep, "seq", whole.alias("requirement_id"), text("verified_answer").alias("verified_answer"), flag.alias("needs_human_review"), text("reason").alias("reason"))


def answers(df: DataFrame, raw: str = "raw") -> DataFrame:
    """F32: agent answers (requirement_id, raw) to evaluations; what cannot be read is the fallback row with the cause as reasoning."""
    text = unfenced(F.col(raw))
    get = lambda f: F.get_json_object("_t", f"$.{f}")
    df = df.withColumn("_t", text).withColumn("_a", F.lower(get("answer"))).withColumn("_c", X.coerced_float(get("confidence")))
    cause = (
        F.when(F.try_parse_json("_t").isNull(), "not JSON")
        .when(F.col("_a").isNull(), "no answer")
        .when(~F.col("_a").isin(*ANSWERS), F.format_string("'%s' is no answer", "_a"))
        .when(~F.col("_c").between(0.0, 1.0), "confidence is not between 0 and 1")
    )
    good = cause.isNull()
    number = get("page_number")
    page = F.when(number.rlike(r"^-?\d+\.\d+$"), F.when(F.get_json_object("_t", "$.page_number").isNotNull() & ~F.col("_t").rlike(r'"page_number"\s*:\s*"'), number.try_cast("double").cast("int")).otherwise(0)).otherwise(X.coerced_int(number))
    pick = lambda c, other: F.when(good, c).otherwise(F.lit(other) if not isinstance(other, Column) else other)
    return df.select(
        "requirement_id", pick(F.col("_a"), "no").alias("answer"), pick(X.coerced_text(get("citation_text")), "").alias("citation_text"), pick(X.coerced_text(get("source_file")), "").alias("source_file"),
        pick(page, 0).alias("page_number"), pick(F.col("_c"), 0.0).alias("confidence"), pick(X.coerced_text(get("reasoning")), F.concat(F.lit("Parse error: "), cause)).alias("reasoning"), (~good).alias("needs_human_review"))
