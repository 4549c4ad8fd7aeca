"""Quality metrics of requirements and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ANSWERS

# Thresholds of the quality gates.
GATES = {"semantic_recall": 0.60, "format_adherence": 0.90, "fallback_rate": 0.20, "mean_confidence": 0.40, "grounding": 0.50, "hallucination": 0.10}
RECALL_AT, UNGROUNDED_BELOW = 0.65, 0.30


def rates(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """One row with the share of rows of which each predicate holds."""
    return df.agg(*(F.round(F.avg(F.coalesce(p, F.lit(False)).cast("int")), 6).alias(n) for n, p in predicates.items()))


def uniqueness(df: DataFrame, column: str) -> DataFrame:
    """A18, A22."""
    return df.agg(F.count(column).alias("n"), F.countDistinct(column).alias("n_distinct"), F.round(F.countDistinct(column) / F.count(column), 6).alias("uniqueness"))


def duplicates(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def recall(best: DataFrame, threshold: float = RECALL_AT) -> DataFrame:
    """Recall, mean and median of best similarities; share under the hallucination bound."""
    s = F.col("similarity")
    return best.agg(F.count("*").alias("n"), F.round(F.avg((s >= threshold).cast("int")), 6).alias("recall"), F.round(F.avg(s), 6).alias("mean_similarity"), F.round(F.percentile(s, F.lit(0.5)), 6).alias("median_similarity"), F.round(F.avg((s < UNGROUNDED_BELOW).cast("int")), 6).alias("hallucination_rate"))


def lowest(best: DataFrame, n: int = 10) -> DataFrame:
    """O5."""
    return best.orderBy("similarity", "query_id").limit(n)


def answer_distribution(evaluations: DataFrame) -> DataFrame:
    """Rows and mean confidence of every answer, also of those that do not occur."""
    every = evaluations.sparkSession.createDataFrame([(a,) for a in ANSWERS], "answer string")
    counts = evaluations.groupBy("answer").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return every.join(counts, "answer", "left").select("answer", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_confidence", F.lit(0.0)).alias("mean_confidence"))


def count_variance(first: DataFrame, second: DataFrame) -> DataFrame:
    """Difference of two counts over the larger."""
    one = first.agg(F.count("*").alias("n")).unionByName(second.agg(F.count("*").alias("n")))
    return one.agg(F.min("n").alias("fewer"), F.max("n").alias("more")).withColumn("variance", F.when(F.col("more") > 0, F.round((F.col("more") - F.col("fewer")) / F.col("more"), 6)).otherwise(0.0))


def report(scores: dict[str, float], spark) -> DataFrame:
    """Scores with their thresholds and whether each passes; fallback and hallucination are upper bounds."""
    rows = [(n, float(s), GATES.get(n), None if n not in GATES else (s <= GATES[n] if n in ("fallback_rate", "hallucination") else s >= GATES[n])) for n, s in scores.items()]
    return spark.createDataFrame(rows, "metric string, score double, threshold double, passed boolean")
