"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions.

Targets.  Sources by code point, null last, weigh 1, 2, 3, repeating, and share
the corpus' size.  A target stops at EPOCHS times its source's size, the excess
being shared again by weight until none is above: level * weight, capped.

Schedule.  The mix is a row of slots of equal token counts.  Slot i has the
golden-ratio point frac(i / phi), in integers, and belongs to the source in
whose stretch of the cumulative targets the point falls; any run of slots thus
holds each source in proportion.  A slot's rank among its source's slots names
the block it takes.  Blocks cut a source's stream: its documents in hashed
order, up to EPOCHS times over.

Scale.  A slot holds the square root of the corpus' words over FINE, so there are
FINE times that root of slots at every size.  Sources are tables: they are ranked
and summed in two levels, by the partitions of a sort, and points find their
stretch by an equality join on cells of the unit interval.  Running sums over a
source take two levels of about the root of the rows each, over hash ranges and
inside them, and ranks of slots likewise, so a source with a third of all rows is
spread over many tasks.  Rows alike in id, source and text are counted first and
told apart by a number.

Cases: null and blank texts have size 0 and nothing is taken of them; a null
source is a source; repeated rows are taken apart; an empty table gives an empty
result; further columns are passed through by mix() and ignored otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checked, settle

EPOCHS = 3
#: A slot is the root of the corpus' words over FINE, one word at least.
FINE = 128
#: Points are multiples of 2**-31; STRIDE is the odd number nearest to 2**31 / phi.
PERIOD, STRIDE = 1 << 31, 1327217885
#: Numbers of one row's repeats that are written out at once.
REPEATS = 10_000


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _root(n: int) -> int:
    """A power of two near the square root."""
    return 1 << max(0, round(math.log2(max(n, 1)) / 2))


def _running(rows: DataFrame, value: Column) -> DataFrame:
    """rows, sorted and numbered by `place` = partition << 33 + index, with `rank` and `before`, the sum of value before them.

    Only one row per partition of the sort is summed in one task.
    """
    part = F.shiftright("place", 33)
    rows = rows.withColumn("_p", part).withColumn("_v", value)
    inner = Window.partitionBy("_p").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as the sort has partitions
    sums = rows.groupBy("_p").agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    sums = sums.select("_p", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(outer), F.lit(0)).alias("_s"))
    rows = rows.withColumn("rank", F.count("*").over(inner)).withColumn("before", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    return rows.join(F.broadcast(sums), "_p").withColumn("rank", F.col("rank") + F.col("_n")).withColumn("before", F.col("before") + F.col("_s")).drop("_p", "_v", "_n", "_s")


def targets(totals: DataFrame) -> DataFrame:
    """(k, source, source_size, target, low, high) of every source, from rows (source, source_size); low and high bound its stretch of points."""
    placed = settle(totals.orderBy(F.asc_nulls_last("source")).withColumn("place", F.monotonically_increasing_id()), "sources")
    ranked = settle(_running(placed, F.lit(0)).withColumn("weight", F.col("rank") % 3 + 1).select("source", "source_size", "place", F.col("rank").alias("k"), "weight"), "weights")
    total, weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1))).first()
    cap, level, count = F.col("source_size") * EPOCHS, total / weight, -1
    while True:  # the level rises until no further source is above its cap
        over = cap < F.lit(level) * F.col("weight")
        n, held, rest = ranked.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == count or not rest:
            break
        count, level = n, (total - held) / rest
    found = ranked.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight")))
    found = found.withColumn("share", F.round(F.col("target") * 1024).cast("decimal(38,0)"))  # whole numbers, so stretches meet without gaps
    sum_ = max(1, found.agg(F.coalesce(F.sum("share"), F.lit(0))).first()[0])
    edge = lambda c: F.expr(f"({c}) * {PERIOD} div {sum_}").cast("long")
    return settle(_running(found, F.col("share")).select("k", "source", "source_size", "target", edge("before").alias("low"), edge("before + share").alias("high")), "targets")


def _placed(sized: DataFrame, ranges: int) -> DataFrame:
    """sized (source, size, order, ...) with `start`, the words before it in its source's shuffled stream."""
    rows = sized.withColumn("range", F.shiftrightunsigned("order", 64 - int(math.log2(ranges))).cast("long") if ranges > 1 else F.lit(0).cast("long"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source", "range").agg(F.sum("size").alias("words")).select(F.col("source").alias("_s"), F.col("range").alias("_r"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("_b"))
    inside = Window.partitionBy("source", "range").orderBy("order", "size", "mark", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_i", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(starts, rows.source.eqNullSafe(starts._s) & (rows.range == starts._r)).withColumn("start", F.col("_i") + F.col("_b")).drop("_s", "_r", "_b", "_i", "range")


def _slots(shares: DataFrame, n: int) -> DataFrame:
    """(number, k, block): slot number, its source and its rank among that source's slots."""
    spark, chunk = shares.sparkSession, _root(n)
    cell = PERIOD // min(PERIOD, max(1 << 12, 4 * _root(shares.count()) ** 2))
    point = F.pmod(F.pmod(F.col("id"), F.lit(PERIOD)) * STRIDE, F.lit(PERIOD))
    rows = spark.range(n).select(F.col("id").alias("number"), point.alias("point")).withColumn("cell", F.expr(f"point div {cell}"))
    spans = shares.where("low < high").select("k", "low", "high", F.explode(F.sequence(F.expr(f"low div {cell}"), F.expr(f"(high - 1) div {cell}"))).alias("cell"))
    rows = rows.join(checked(settle(spans, "spans")), "cell").where("low <= point AND point < high").select("number", "k", F.expr(f"number div {chunk}").alias("chunk"))
    before = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("k", "chunk").agg(F.count("*").alias("n")).select("k", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("k", "chunk").orderBy("number")) - 1)
    return ranked.join(starts, ["k", "chunk"]).select("number", "k", (F.col("rank") + F.col("start")).alias("block"))


def _keys() -> dict[str, Column]:
    """What tells rows apart, repeated ones aside: id, source, size and a hash of the text."""
    return {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), "size": n_words(F.col("text")), "mark": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))}


def schedule(docs: DataFrame) -> DataFrame:
    """The mix: pieces (number, doc_id, mark, row, source, size, source_size, target, words).

    `number` is the slot, null for a piece that no slot takes; a document's
    pieces of one slot carry the words that the slot takes of it.  `mark` is a
    hash of the text and `row` tells repeated rows apart.
    """
    known = _keys()
    base = settle(docs.select(*(c.alias(n) for n, c in known.items())).groupBy(*known).agg(F.count("*").alias("_n")), "sizes")
    some = base.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {REPEATS}"))))
    sized = some.withColumn("row", F.explode(F.sequence(F.col("_c") * REPEATS, F.least("_n", (F.col("_c") + 1) * REPEATS) - 1))).drop("_n", "_c")
    sized = sized.withColumn("order", F.xxhash64("doc_id", "mark", "row"))
    shares = targets(base.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")))
    total, rows = base.agg(F.coalesce(F.sum(F.col("size") * F.col("_n")), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    slot = max(1, math.isqrt(total) // FINE)
    share = checked(shares.select("k", F.col("source").alias("_s"), "source_size", "target"))
    placed = _placed(sized, _root(rows))
    placed = placed.join(share, placed.source.eqNullSafe(share._s)).drop("_s", "order")
    epochs = F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.lit(EPOCHS - 1), F.floor(F.col("target") * 1.0001 / F.greatest("source_size", F.lit(1))).cast("int"))))
    begun = placed.withColumn("epoch", F.explode(epochs)).withColumn("begin", F.col("start") + F.col("epoch") * F.col("source_size"))
    cut = F.when(F.col("size") > 0, F.sequence(F.expr(f"begin div {slot}"), F.expr(f"(begin + size - 1) div {slot}")))
    pieces = begun.withColumn("block", F.explode_outer(cut))
    words = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * slot) - F.greatest(F.col("begin"), F.col("block") * slot)
    joined = pieces.withColumn("words", F.coalesce(words, F.lit(0))).join(_slots(shares, round(total / slot)), ["k", "block"], "left")
    return joined.select("number", "doc_id", "mark", "row", "source", "size", "source_size", "target", "words")


def _taken(docs: DataFrame) -> DataFrame:
    return schedule(docs).groupBy("doc_id", "mark", "row", "source", "size", "source_size", "target").agg(F.sum(F.when(F.col("number").isNotNull(), F.col("words")).otherwise(0)).cast("long").alias("taken"))


def taken(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target and taken."""
    return _taken(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns.

    A document is given once for each full copy taken, and once more for a last
    part of half its words or more; one of which less is taken is left out.  For
    rows alike in id, source and text one of them is given as often as all are.
    """
    known = _keys()
    copies = _taken(docs).withColumn("__loom_n", F.when(F.col("size") > 0, F.expr("cast(floor(taken / size + 0.5D) as int)")).otherwise(0))
    wanted = copies.groupBy(*known).agg(F.sum("__loom_n").alias("__loom_n"), F.count("*").alias("__loom_r")).where("__loom_n > 0")
    wanted = wanted.select(*(F.col(n).alias(f"__loom_{n}") for n in known), "__loom_n", "__loom_r")
    held = docs.join(wanted, [c.eqNullSafe(F.col(f"__loom_{n}")) for n, c in known.items()])
    groups = [f"__loom_{n}" for n in known]
    whole = F.struct(*docs.columns)
    single = held.where("__loom_r = 1").select(*docs.columns, "__loom_n")
    twins = held.where("__loom_r > 1").groupBy(*groups).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("__loom_x"), F.first("__loom_n").alias("__loom_n")).select("__loom_x.*", "__loom_n")
    return single.unionByName(twins).withColumn("__loom_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__loom_n")))).select(*docs.columns)
