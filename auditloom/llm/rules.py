"""Quality rules by hashed n-gram log-likelihood ratio, in DataFrame functions only.

Two multinomials over hashed single words and word pairs are counted: one of
trusted target text (labelled rows of good quality that are not toxic), one of
the raw corpus (every document).  A document's score is the sum of its n-grams'
smoothed log-likelihood ratios divided by their number; it passes from THRESHOLD
on.  Documents that fail the base rules (fewer than 50 words, or over half of
the words in repeated 3-word windows) never pass.

Each text is split once, and counts per bucket are pre-aggregated before the
shuffle.  The number of buckets grows with the corpus (see `grams`).  Up to DENSE
buckets a family, scores are folded inside the row against an array, without a
join or a shuffle.  A larger table is joined to the n-grams, by broadcast up to
WIDE rows, and scores are summed per text before they are shuffled.
Windows are compared by 64-bit hashes.

Bounds: at most SAMPLE_ROWS labelled rows, those with the least hash, are
trusted; they are broadcast.  Everything else covers all rows.

Cases: a null text is empty and fails; without trusted rows all ratios are 0 and
only the base rules decide; repeated rows are judged alike; further columns are
passed through or ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, settle, words
from .grams import bucket_count, with_text_key

#: Buckets a family for a small corpus, and for larger ones so many times the square root of their words.
BUCKETS, ROOT = 1 << 13, 6
#: So many buckets a family may be sent with the plan: 8 MB of doubles for both.
DENSE = 1 << 19
#: So many rows of a larger table may be broadcast: under 1 GB.
WIDE = 1 << 25
SAMPLE_ROWS = 20_000
THRESHOLD = -0.05
#: A bucket's target count is drawn to what the raw model expects of it, with the weight of so many n-grams.
PRIOR = 16
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _upto(n: Column, f: Callable[[Column], Column], kind: str) -> Column:
    """f(0) .. f(n - 1) as an array."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast(f"array<{kind}>"))


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _buckets(h: Column, n: int) -> Column:
    """Buckets of single words (from 0) and of word pairs (from n)."""
    pairs = _upto(F.size(h) - 1, lambda i: F.pmod(F.xxhash64(F.get(h, i), F.get(h, i + 1)), F.lit(n)) + n, "bigint")
    return F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(n))), pairs)


def _repeated(h: Column) -> Column:
    """How many words lie in 3-word windows that occur more than once."""

    def covered(windows: Column) -> Column:
        def twice(sorted_: Column) -> Column:
            return F.filter(sorted_, lambda p, i: (F.get(sorted_, i - 1)["x"] == p["x"]) | (F.get(sorted_, i + 1)["x"] == p["x"]))

        marked = let(F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), twice)
        places = F.sort_array(F.transform(marked, lambda p: p["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(places, start, lambda s, i: F.struct((s["n"] + F.least(i - s["last"], F.lit(3))).alias("n"), i.alias("last")))["n"]

    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(covered(windows))

    return let(_upto(F.size(h) - 2, lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)), "bigint"), count)


def base_measures(text: Column) -> dict[str, Column]:
    """Measures that need no words array."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    return {
        "word_chars": F.length(F.translate(text, WHITE, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def trusted(labels: DataFrame) -> DataFrame:
    """At most SAMPLE_ROWS ids of labelled rows that are good and not toxic."""
    rows = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("q"), F.coalesce(F.max("toxic"), F.lit(0)).alias("t"))
    return rows.where("q = 1 AND t = 0").select("_id").orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS).withColumn("_target", F.lit(1))


def _counts(docs: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(trusted(labels)), "_id", "left")  # at most SAMPLE_ROWS rows
    grams = texts.select("_target", F.explode(let(_hashes(F.col("text")), lambda h: _buckets(h, n))).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_target").alias("target"))


def ratios(docs: DataFrame, labels: DataFrame, n: int) -> np.ndarray:
    """The log-likelihood ratio of every bucket: 2 * n numbers."""
    found = _counts(docs, labels, n).toArrow()  # at most 2 * n rows, n at most DENSE
    bucket = found.column("bucket").to_numpy()
    raw, target = np.zeros(2 * n), np.zeros(2 * n)
    raw[bucket], target[bucket] = found.column("raw").to_numpy(), found.column("target").to_numpy()
    out = np.zeros(2 * n)
    if target.any():
        for part in (slice(0, n), slice(n, None)):
            share = target[part].sum() / max(1, raw[part].sum())
            out[part] = np.log((target[part] + PRIOR) / (share * raw[part] + PRIOR))
    return out


def dense_llr(table: np.ndarray) -> Callable[[Column], Column]:
    """From the hashes of a text's words to its score, by a table in the plan."""
    n = len(table) // 2
    known = F.split(F.lit(" ".join(f"{x:.8f}" for x in table.tolist())), " ").cast("array<double>")

    def mean(buckets: Column) -> Column:
        total = F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(known, b.cast("int")))
        return F.when(F.size(buckets) > 0, total / F.size(buckets)).otherwise(F.lit(0.0))

    return lambda h: let(_buckets(h, n), mean)


def joined_llr(docs: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """(__loom_a, __loom_b, __loom_llr) per text with words, by a join with the table: equal texts have one mean."""
    counts = settle(_counts(docs, labels, n), "counts")
    small = counts.count() <= WIDE
    family = (F.col("bucket") >= n).cast("int")
    share = {r.f: r.t / max(1, r.r) for r in counts.groupBy(family.alias("f")).agg(F.sum("raw").alias("r"), F.sum("target").alias("t")).collect()}
    if any(share.values()):
        ratio = F.log((F.col("target") + PRIOR) / (F.when(family == 0, share.get(0, 0.0)).otherwise(share.get(1, 0.0)) * F.col("raw") + PRIOR))
    else:
        ratio = F.lit(0.0)
    grams = with_text_key(docs.select("text")).select("__loom_a", "__loom_b", F.explode(let(_hashes(F.col("text")), lambda h: _buckets(h, n))).alias("bucket"))
    table = counts.select("bucket", ratio.alias("x"))
    return grams.join(F.broadcast(table) if small else table, "bucket").groupBy("__loom_a", "__loom_b").agg(F.avg("x").alias("__loom_llr"))


def verdict(text: Column, llr: Callable[[Column], Column]) -> Column:
    """Struct of all measures, base_failed, llr and kept."""

    def of(h: Column) -> Column:
        return F.struct(F.size(h).cast("long").alias("n_words"), _repeated(h).cast("long").alias("n_repeat_words"), llr(h).alias("llr"))

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
        return F.struct(m["n_words"].alias("n_words"), m["n_repeat_words"].alias("n_repeat_words"), m["llr"].alias("llr"), failed.alias("base_failed"), (~failed & (m["llr"] >= THRESHOLD)).alias("kept"))

    return let(let(_hashes(text), of), judged)


def _scored(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Column]:
    """docs, with a score beside each row where the table is too large for the plan, and the verdict on a row."""
    n = bucket_count(docs, ROOT, BUCKETS)
    if n <= DENSE:
        return docs, verdict(F.col("text"), dense_llr(ratios(docs, labels, n)))
    rows = with_text_key(docs).join(joined_llr(docs, labels, n), ["__loom_a", "__loom_b"], "left")
    return rows, verdict(F.col("text"), lambda h: F.coalesce("__loom_llr", F.lit(0.0)))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, the measures, llr, base_failed and kept."""
    docs, found = _scored(docs, labels)
    rows = docs.select("doc_id", *(c.alias(n) for n, c in base_measures(F.col("text")).items()), found.alias("v"))
    return rows.select("doc_id", "v.n_words", "word_chars", "n_symbols", "n_dup_lines", "v.n_repeat_words", "v.llr", "v.base_failed", "v.kept")


def select(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    rows, found = _scored(docs, labels)
    return rows.where(found["kept"]).select(*docs.columns)
