"""Pluggable model steps: embedding, extraction, evaluation.

Each is a small protocol with a deterministic default, run batch-wise in
mapInArrow or as plain columns.  Defaults need no network and no model files.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import text as X

DIMENSIONS = 64


class Embedder(Protocol):
    """Texts of a batch to vectors of unit length; loaded once per worker."""

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class Extractor(Protocol):
    """Requirements of a section."""

    def extract(self, sections: DataFrame) -> DataFrame: ...


class Evaluator(Protocol):
    """An answer to a requirement from its ranked passages."""

    def evaluate(self, matched: DataFrame) -> DataFrame: ...


class HashedEmbedder:
    """The default: hashed word counts with signs, of unit length; a text without words is zero.

    A whole batch is hashed and counted by array operations.
    """

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions

    def encode_column(self, column: pa.Array) -> np.ndarray:
        words = pc.split_pattern_regex(pc.utf8_lower(column.fill_null("")), pattern=r"[^\p{L}\p{N}]+")
        row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy())
        flat = words.flatten().dictionary_encode()
        known = flat.dictionary.to_pandas().to_numpy(dtype=object)
        marks = pd.util.hash_array(known, categorize=False) if len(known) else np.zeros(0, dtype=np.uint64)
        sign = np.where(known == "", 0.0, np.where(marks >> np.uint64(63), 1.0, -1.0))
        code = flat.indices.to_numpy()
        slot = row * self.dimensions + (marks % np.uint64(self.dimensions)).astype(np.int64)[code]
        out = np.bincount(slot, weights=sign[code], minlength=len(words) * self.dimensions).reshape(-1, self.dimensions)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1.0)

    def encode(self, texts: list[str]) -> list[list[float]]:
        return self.encode_column(pa.array(texts, pa.string())).tolist()


def embed(df: DataFrame, text: str, embedder: Embedder | None = None, out: str = "vec") -> DataFrame:
    """df with a vector column."""
    model = embedder or HashedEmbedder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            if isinstance(model, HashedEmbedder):
                made = model.encode_column(column)
                flat = pa.array(made.ravel())
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * made.shape[1]), flat)
            else:
                vectors = pa.array(model.encode(["" if t is None else t for t in column.to_pylist()]), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


class RuleExtractor:
    """Every sentence with an obligation phrase is a requirement."""

    def extract(self, sections: DataFrame) -> DataFrame:
        rows = sections.select("doc_id", "section_no", "heading", "page_start", F.posexplode(X.sentences(F.regexp_replace("text", "\n", " "))).alias("item_no", "quote")).where(X.has_obligation(F.col("quote")))
        level = F.when(F.col("quote").rlike(X.OBLIGATION_GROUPS["prohibition"]), "prohibited").when(F.col("quote").rlike(X.OBLIGATION_GROUPS["duty"]), "mandatory").otherwise("recommended")
        timeframe = F.nullif(F.regexp_extract("quote", r"(?i)\bwithin \d+ (?:business |calendar )?days\b", 0), F.lit(""))
        kind = F.coalesce(*(F.when(c, name) for name, c in X.obligation_classes(F.col("quote")).items()))
        condition = F.nullif(F.regexp_extract("quote", r"(?i)\b(?:if|when|unless|upon)\s[^,.;]+", 0), F.lit(""))
        action = F.nullif(F.regexp_extract("quote", r"(?i)\b(?:must|shall|should|required to|responsible for)\s+(?:not\s+)?([^,.;]+)", 1), F.lit(""))
        return rows.select("doc_id", "section_no", "item_no", F.format_string("Does the P&P state that %s?", F.rtrim("quote", F.lit("."))).alias("text"), F.format_string("%s, page %d", "heading", "page_start").alias("reference"), kind.alias("obligation_type"), level.alias("obligation_level"), action.alias("action_required"), condition.alias("condition"), timeframe.alias("timeframe"), F.col("quote").alias("exact_quote"), F.col("heading").alias("section_heading"))


class RuleEvaluator:
    """The best passage decides: similar enough is yes, somewhat is partial, else no; unsure rows are flagged."""

    def __init__(self, yes: float = 0.35, partial: float = 0.2) -> None:
        self.yes, self.partial = yes, partial

    def evaluate(self, matched: DataFrame) -> DataFrame:
        """matched: (requirement_id, similarity, text, source_file, page_number), the best passage of each."""
        s = F.coalesce("similarity", F.lit(0.0))
        answer = F.when(s >= self.yes, "yes").when(s >= self.partial, "partial").otherwise("no")
        confidence = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.abs(s - self.partial))), 5)
        return matched.select("requirement_id", answer.alias("answer"), F.substring(F.coalesce("text", F.lit("")), 1, 200).alias("citation_text"), F.coalesce("source_file", F.lit("")).alias("source_file"), F.coalesce("page_number", F.lit(0)).alias("page_number"), confidence.alias("confidence"), F.format_string("Best passage has similarity %.3f.", s).alias("reasoning"), (confidence < 0.7).alias("needs_human_review"), F.lit("pending").alias("status"), F.lit("").alias("reviewer_notes"))
