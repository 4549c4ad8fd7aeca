"""Size of the hashed n-gram tables of `quality` and `rules`.

Tables grow with the square root of the corpus.  Distinct n-grams grow slower
than n-grams, and an n-gram can move a score only where the target model expects
PRIOR of it or more; those have a share of the corpus that stays, so they are
bounded in number, and more buckets only keep the rare rest apart.  A table then
stays small beside the corpus, and so does what tasks shuffle to fill it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a word and what separates it from the next, in the mean.
CHARS = 6


def bucket_count(docs: DataFrame, root: int, least: int) -> int:
    """`root` buckets times the square root of the words of the corpus, `least` at least."""
    chars = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    return max(least, root * math.isqrt(chars // CHARS))


def with_text_key(docs: DataFrame) -> DataFrame:
    """docs and two hashes of the text, by which rows of equal text are known."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("__loom_a", F.xxhash64(text)).withColumn("__loom_b", F.xxhash64(F.lit(1), text))
