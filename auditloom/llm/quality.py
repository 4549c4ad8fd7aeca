"""Quality selection by importance resampling with hashed n-gram models.

Two generative models are counted over hashed n-grams: one of the target text
(labelled rows of good quality that are not toxic) and one of the raw corpus
(every document).  A document's weight is the ratio of its likelihoods under
both, and documents are sampled without replacement by those weights: each log
weight gets Gumbel noise seeded by its doc_id and the k largest are taken.

The n-grams are single words, word pairs, and pairs of word shapes with a mark
for a word that repeats the one before.  A log weight is the sum of their log
ratios, tempered by PASSAGE / (PASSAGE + number of n-grams): a long document
weighs as a passage of PASSAGE n-grams would, so length alone decides nothing
and the noise counts between documents that are about as good.

k is either given or the size of the target in the corpus: the share of good
quality among the labelled rows times the number of documents with words.
Toxic rows of good quality read like the target, so they count for k though they
do not train the model.

The number of buckets grows with the corpus (see `grams`).  Up to DENSE buckets
the table is sent to the tasks as an array; a larger one is joined to the
n-grams, by broadcast up to WIDE rows.

Bounds: at most SAMPLE_ROWS labelled rows, those with the least hash, are used,
so they may be broadcast.  Raw counts, weights and the choice cover all rows.

Cases: a null or blank text has no n-grams, weight 0 and is not kept; without
labelled target rows every weight is 0 and all documents with words are kept;
documents tied with the last one taken are taken too; rows without doc_id share
one seed; repeated labels count once, with their least quality; further columns
are passed through or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import prepare, settle
from .grams import bucket_count, with_text_key

#: Buckets for a small corpus, and for larger ones so many times the square root of their words.
BUCKETS, ROOT = 1 << 15, 12
#: So many buckets may be broadcast: 64 MB of doubles.
DENSE = 1 << 23
#: So many rows of a larger table may be broadcast for a join: under 1 GB.
WIDE = 1 << 25
SAMPLE_ROWS = 20_000
#: N-grams of the passage that a long document weighs as.
PASSAGE = 64
#: A bucket's target count is drawn to what the raw model expects of it, with the weight of so many n-grams.
PRIOR = 16

_U = np.uint64
_FAMILY = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9))
#: Classes of a word's first and last byte: lower, upper, digit, high byte; other bytes stand for themselves.
_SHAPE = np.arange(256, dtype=np.int64)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 1, 2, 3, 1


def features(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(doc, bucket) of every n-gram of the texts."""
    words = K.scan(column)
    if not len(words.hash):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    second = words.data[np.minimum(words.start + 1, words.end - 1)]
    shape = (_SHAPE[words.data[words.start]] << 16) | (_SHAPE[second] << 8) | _SHAPE[words.data[words.end - 1]]
    pair_doc, pair = K.ngrams(words, 2)
    inside = words.doc[1:] == words.doc[:-1]
    shapes = ((shape[:-1] << 25) | (shape[1:] << 1) | (words.hash[:-1] == words.hash[1:]))[inside].astype(_U)
    found = (words.hash, pair, shapes)
    bucket = np.concatenate([(K.mix64(x ^ s) % _U(buckets)).astype(np.int64) for x, s in zip(found, _FAMILY, strict=True)])
    return np.concatenate([words.doc, pair_doc, pair_doc]), bucket


def _counter(buckets: int):
    """Counts by bucket: one row a task and bucket up to DENSE buckets, one a slice and bucket beyond."""

    def rows(seen: np.ndarray, raw: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = buckets <= DENSE
        raw, target = (np.zeros(buckets if dense else 0, dtype=np.int64) for _ in range(2))
        for batch in batches:
            for part in K.slices(batch, "text"):
                doc, bucket = features(part.column("text"), buckets)
                wanted = (part.column("target").fill_null(0).to_numpy() == 1)[doc]
                if dense:
                    raw += np.bincount(bucket, minlength=buckets)
                    target += np.bincount(bucket[wanted], minlength=buckets)
                else:
                    seen, at = np.unique(bucket, return_inverse=True)
                    yield rows(seen, np.bincount(at, minlength=len(seen)), np.bincount(at[wanted], minlength=len(seen)))
        seen = np.flatnonzero(raw)
        for low in range(0, len(seen), 1 << 18):
            some = seen[low : low + (1 << 18)]
            yield rows(some, raw[some], target[some])

    return run


def labelled(labels: DataFrame) -> DataFrame:
    """At most SAMPLE_ROWS rows (doc_id, target): 1 trains the target model, 0 is of bad quality, 2 good but toxic."""
    kind = F.when(F.min("quality") != 1, 0).when(F.coalesce(F.max("toxic"), F.lit(0)) == 0, 1).otherwise(2)
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(kind.alias("target"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)


def _marked(docs: DataFrame, sample: DataFrame) -> DataFrame:
    weights = [c for c in ("__loom_n", "__loom_w") if c in docs.columns]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *weights)
    return texts.join(F.broadcast(sample), "doc_id", "left")  # at most SAMPLE_ROWS rows


def _fit(docs: DataFrame, sample: DataFrame, buckets: int) -> DataFrame:
    """(bucket, raw, target) of every n-gram bucket of docs."""
    counts = _marked(docs, sample).mapInArrow(_counter(buckets), "bucket long, raw long, target long")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit(docs: DataFrame, sample: DataFrame, buckets: int) -> np.ndarray:
    """Per bucket, the log ratio of the smoothed target and raw models."""
    found = _fit(docs, sample, buckets).toArrow()  # at most DENSE rows
    raw, target = np.zeros(buckets), np.zeros(buckets)
    bucket = found.column("bucket").to_numpy()
    raw[bucket], target[bucket] = found.column("raw").to_numpy(), found.column("target").to_numpy()
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + PRIOR) / (raw * (target.sum() / raw.sum()) + PRIOR))


def _joined(docs: DataFrame, sample: DataFrame, buckets: int) -> DataFrame:
    """docs with __loom_n and __loom_w, n-grams and log weight of the text, by a join with the table."""
    counts = settle(_fit(docs, sample, buckets), "counts")
    raw, target = counts.agg(F.sum("raw"), F.sum("target")).first()
    ratio = F.log((F.col("target") + PRIOR) / (F.col("raw") * (target / raw) + PRIOR)) if target else F.lit(0.0)
    texts = with_text_key(docs.select(F.col("text").cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text"):
                doc, bucket = features(part.column("text"), buckets)
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([part.column("__loom_a").take(at), part.column("__loom_b").take(at), pa.array(bucket)], names=["__loom_a", "__loom_b", "bucket"])

    keys = ["__loom_a", "__loom_b"]
    known = counts.select("bucket", ratio.alias("x"))
    grams = texts.mapInArrow(run, "__loom_a long, __loom_b long, bucket long").join(F.broadcast(known) if counts.count() <= WIDE else known, "bucket")
    weights = grams.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("x").alias("w")).join(texts.groupBy(*keys).agg(F.count("*").alias("copies")), keys)
    weights = settle(weights.select(*keys, (F.col("n") / F.col("copies")).cast("long").alias("__loom_n"), (F.col("w") / F.col("copies")).alias("__loom_w")), "weights")
    return with_text_key(docs).join(weights, keys, "left").drop(*keys)


def gumbel(ids: pa.Array) -> np.ndarray:
    """Gumbel noise that depends on the id alone."""
    seed = ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(_U)
    return -np.log(-np.log(K.unit(K.mix64(seed * _FAMILY[0] + _FAMILY[1]))))


def weigh(part: pa.RecordBatch, ratio: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, log weight, perturbed log weight) of a batch with doc_id and text, or with the columns of _joined()."""
    if ratio is None:
        n, weight = (part.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("__loom_n", "__loom_w"))
    else:
        doc, bucket = features(part.column("text"), len(ratio))
        n = np.bincount(doc, minlength=part.num_rows)
        weight = np.bincount(doc, weights=ratio[bucket], minlength=part.num_rows)
    weight = weight * (PASSAGE / (PASSAGE + n))
    return n, weight, weight + gumbel(part.column("doc_id"))


class Model:
    """docs, with weights beside the rows where the table is too large to broadcast, and the table where it is not."""

    def __init__(self, docs: DataFrame, sample: DataFrame) -> None:
        buckets = bucket_count(docs, ROOT, BUCKETS)
        self.sample, self.table = sample, None
        if buckets <= DENSE:
            self.docs, self.table = docs, docs.sparkSession.sparkContext.broadcast(fit(docs, sample, buckets))
        else:
            self.docs = _joined(docs, sample, buckets)

    def score(self) -> DataFrame:
        """(doc_id, n_grams, log_weight, key, target) per document; target is null where unlabelled."""
        table = self.table

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in K.slices(batch, "text"):
                    n, weight, key = weigh(part, table and table.value)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(weight), pa.array(key), part.column("target").cast(pa.int32())], names=["doc_id", "n_grams", "log_weight", "key", "target"])

        return _marked(self.docs, self.sample).mapInArrow(run, "doc_id long, n_grams long, log_weight double, key double, target int")


def kth_largest(scores: DataFrame, k: int) -> float:
    """The k-th largest key, by digits: four counts of at most 65,536 bins, never a sort of all keys."""
    if k <= 0:
        return float("inf")
    bits = scores.where("n_grams > 0").mapInArrow(_ordered, "bits long")
    prefix = 0
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned("bits", shift).bitwiseAND(F.lit(0xFFFF))
        held = bits if shift == 48 else bits.where(F.shiftrightunsigned("bits", shift + 16) == prefix)
        for value, n in sorted(held.groupBy(digit.alias("d")).count().collect(), reverse=True):
            if k <= n:
                break
            k -= n
        else:
            return float("-inf")
        prefix = prefix << 16 | value
    raw = np.array([prefix], dtype=_U)
    back = raw ^ _U(1 << 63) if prefix >> 63 else ~raw
    return float(back.view(np.float64)[0])


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column("key").to_numpy().view(_U)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(raw >> _U(63), ~raw, raw | _U(1 << 63)).view(np.int64))], names=["bits"])


def target_size(scores: DataFrame) -> int | None:
    """How many documents with words are like the target, by its share of the labelled ones; None without labels."""
    n, known, good = scores.where("n_grams > 0").agg(F.count("*"), F.count("target"), F.count_if(F.col("target") > 0)).first()
    return -(-n * good // known) if good else None


def _cut(scores: DataFrame, k: int | None) -> float:
    """The perturbed weight from which on documents are taken."""
    k = target_size(scores) if k is None else k
    return float("-inf") if k is None else kth_largest(scores, k)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_grams, log_weight, key and kept."""
    prepare(docs.sparkSession)
    scores = settle(Model(docs, labelled(labels)).score(), "scores")
    return scores.select("doc_id", "n_grams", "log_weight", "key", ((F.col("key") >= _cut(scores, k)) & (F.col("n_grams") > 0)).alias("kept"))


def select(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The rows of docs that resample() keeps, with all their columns.

    Weights are a function of the row, so they are computed once more beside
    the text rather than joined to it.
    """
    prepare(docs.sparkSession)
    model = Model(docs, labelled(labels))
    cut = _cut(settle(model.score(), "scores"), k)
    table, columns = model.table, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text"):
                n, _, key = weigh(part, table and table.value)
                yield part.filter(pa.array((n > 0) & (key >= cut))).select(columns)

    return model.docs.mapInArrow(run, docs.schema)
