"""Nested lists: items, levels and paths as flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .lines import joined


def items(lines: DataFrame) -> DataFrame:
    """(doc_id, node_no, indent, marker, display, kind, text); lines in between continue an item."""
    part = X.list_item(F.col("line"))
    df = lines.select("doc_id", "line_no", "line", *(c.alias(n) for n, c in part.items())).withColumn("is_item", F.col("marker") != "")
    seq = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("node_no", F.sum(F.col("is_item").cast("int")).over(seq).cast("int")).where("node_no > 0").where(F.col("is_item") | ~X.blank(F.col("line")))
    df = df.withColumn("piece", F.when(F.col("is_item"), F.col("body")).otherwise(X.strip(F.col("line"))))
    item = lambda c: F.max(F.when(F.col("is_item"), F.col(c)))
    out = df.groupBy("doc_id", "node_no").agg(item("indent").alias("indent"), item("marker").alias("marker"), item("display").alias("display"), joined("line_no", "piece", " ").alias("text"))
    return out.withColumn("kind", X.marker_type(F.col("marker")))


def _by_type(kinds: Column) -> Column:
    """Levels by a stack of marker types; a known type goes back to its place, an unknown keeps the depth."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.array().cast("array<string>").alias("stack"))

    def step(s: Column, k: Column) -> Column:
        at = F.array_position(s["stack"], k).cast("int")
        stack = F.when(k == "unknown", s["stack"]).when(at > 0, F.slice(s["stack"], F.lit(1), F.greatest(at, F.lit(1)))).otherwise(F.concat(s["stack"], F.array(k)))
        level = F.when(k == "unknown", F.greatest(F.size(s["stack"]), F.lit(1))).when(at > 0, at).otherwise(F.size(s["stack"]) + 1)
        return F.struct(F.concat(s["out"], F.array(level)).alias("out"), stack.alias("stack"))

    return F.aggregate(kinds, start, step, lambda s: s["out"])


def levels(found: DataFrame) -> DataFrame:
    """Add level: rank of the indent if a list has several, else by marker types."""
    rows = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("node_no", "indent", "kind", "marker", "display", "text"))).alias("r"))
    indents = F.array_sort(F.array_distinct(F.transform("r", lambda x: x["indent"])))
    by_indent = X.let(indents, lambda i: F.transform("r", lambda x: F.array_position(i, x["indent"]).cast("int")))
    made = F.when(F.size(indents) > 1, by_indent).otherwise(_by_type(F.transform("r", lambda x: x["kind"])))
    return rows.withColumn("_l", made).select("doc_id", F.inline(F.transform("r", lambda x, i: x.withField("level", F.get("_l", i)))))


def paths(levelled: DataFrame) -> DataFrame:
    """Add parent_no, path and is_root; a stack holds the last node of each level.

    A node deeper than the stack attaches to its deepest node; one that comes
    first without being of level 1 has no parent and is no root.
    """
    rows = levelled.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("node_no", "level", F.lower("marker").alias("key"), "display", "text"))).alias("r"))
    start = F.struct(F.array().cast("array<struct<parent_no:int,path:string,is_root:boolean>>").alias("out"), F.array().cast("array<struct<node_no:int,path:string>>").alias("stack"))

    def step(s: Column, x: Column) -> Column:
        up = F.get(s["stack"], x["level"] - 2)
        path = F.when((x["level"] > 1) & up.isNotNull(), F.concat(up["path"], F.lit("."), x["key"])).otherwise(x["key"])
        kept = F.slice(s["stack"], F.lit(1), x["level"] - 1)
        parent = F.when(x["level"] > 1, F.get(kept, F.size(kept) - 1)["node_no"])
        row = F.struct(parent.alias("parent_no"), path.alias("path"), (x["level"] == 1).alias("is_root"))
        return F.struct(F.concat(s["out"], F.array(row)).alias("out"), F.concat(kept, F.array(F.struct(x["node_no"].alias("node_no"), path.alias("path")))).alias("stack"))

    made = rows.withColumn("_m", F.aggregate("r", start, step, lambda s: s["out"]))

    def whole(x: Column, i: Column) -> Column:
        m = F.get("_m", i)
        return F.struct(*(x[c].alias(c) for c in ("node_no", "level", "display", "text")), *(m[c].alias(c) for c in ("parent_no", "path", "is_root")))

    return made.select("doc_id", F.inline(F.transform("r", whole)))


def parse(lines: DataFrame) -> DataFrame:
    """All of the above: (doc_id, node_no, parent_no, is_root, level, path, marker, text)."""
    return paths(levels(items(lines))).select("doc_id", "node_no", "parent_no", "is_root", "level", "path", F.col("display").alias("marker"), "text")


def trees(parsed: DataFrame) -> DataFrame:
    """The roots of each list as nested JSON; one list is one row.

    Nodes come in order, each after its parent, so a node opens its object and
    what follows tells how many end after it.
    """
    rows = parsed.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("node_no", "parent_no", "is_root", "marker", "text", "level", "path"))).alias("r"))
    first = F.get("r", F.lit(0))["node_no"]
    # depth of every node below its root, 0 where there is none
    deep = lambda s, x: F.concat(s, F.array(F.when(x["is_root"], 1).otherwise(F.coalesce(F.nullif(F.get(s, x["parent_no"] - first), F.lit(0)) + 1, F.lit(0)))))
    rows = rows.withColumn("d", F.aggregate("r", F.array().cast("array<int>"), deep))
    kept = F.filter(F.arrays_zip("r", "d"), lambda x: x["d"] > 0)
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[|\]$", "")

    def piece(x: Column, i: Column) -> Column:
        r, after = x["r"], F.get("k", i + 1)["d"]
        ends = F.when(after.isNull(), F.repeat(F.lit("]}"), x["d"])).when(after > x["d"], F.lit("")).otherwise(F.concat(F.repeat(F.lit("]}"), x["d"] - after + 1), F.lit(", ")))
        return F.concat(F.lit('{"marker": '), quoted(r["marker"]), F.lit(', "text": '), quoted(r["text"]), F.lit(', "level": '), r["level"].cast("string"), F.lit(', "path": '), quoted(r["path"]), F.lit(', "children": ['), ends)

    return rows.withColumn("k", kept).select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("k", piece), ""), F.lit("]")).alias("tree"))
