"""Queries over embeddings: search, similarity joins, clustering, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics, similarity
from ..operators.lines import joined
from ..sources.shared import read_table

#: No two vectors of the shipped table are closer than about 0.5, so queries ask for this.
THRESHOLD = 0.35
OPTIONAL = ["actor", "timeframe"]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def _queries(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir).where("id % 20 = 0").select("id", "vec")


def topk_vectors(spark, sf_dir):
    return similarity.top_k(_queries(spark, sf_dir), vectors(spark, sf_dir).select("id", "vec"), 6)


def search_format(spark, sf_dir):
    found = topk_vectors(spark, sf_dir)
    text = X.result_text(F.col("rank"), F.col("similarity"), F.format_string("policy/%d.pdf", F.col("id") % 9), (F.col("id") % 5).cast("int"), F.format_string("passage %d", "id"))
    return found.withColumn("_t", text).groupBy("query_id").agg(joined("rank", "_t", "\n---\n").alias("text"))


def similar_pairs(spark, sf_dir):
    return similarity.pairs(vectors(spark, sf_dir).select("id", "vec"), THRESHOLD)


def similar_pairs_by_label(spark, sf_dir):
    return similarity.pairs(vectors(spark, sf_dir), THRESHOLD, "label")


def dedupe_leaders(spark, sf_dir):
    return similarity.leaders(vectors(spark, sf_dir), THRESHOLD, "label")


def _requirements(spark, sf_dir) -> DataFrame:
    """A requirement per vector, its fields from the id."""
    k = F.col("id")
    return vectors(spark, sf_dir).select("id", F.concat(F.lit("Does the P&P state rule "), (k % 97).cast("string"), F.lit("?")).alias("text"), F.when(k % 3 != 0, F.format_string("APL %d", k % 4)).alias("reference"), F.when(k % 2 == 0, "Plan").alias("actor"), F.when(k % 5 == 0, "30 days").alias("timeframe"))


def dedupe_merge(spark, sf_dir):
    return similarity.merge(_requirements(spark, sf_dir), dedupe_leaders(spark, sf_dir), OPTIONAL)


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, sf_dir).select("id", "vec")
    return v.where("id % 2 = 0"), v.where("id % 2 = 1")


def best_matches(spark, sf_dir):
    return similarity.best_match(*_halves(spark, sf_dir))


def semantic_recall(spark, sf_dir):
    return metrics.recall(best_matches(spark, sf_dir), 0.3)


def hallucination(spark, sf_dir):
    left, right = _halves(spark, sf_dir)
    best = similarity.best_match(right, left)
    return best.agg(F.count_if(F.col("similarity") < metrics.UNGROUNDED_BELOW).alias("unmatched"), F.count("*").alias("n"))


def grounding(spark, sf_dir):
    left, right = _halves(spark, sf_dir)
    return similarity.best_match(left, right).select("query_id", "match_id", F.round(X.similarity(1 - F.col("similarity"), True), 5).alias("score"), (F.col("similarity") >= metrics.GATES["grounding"]).alias("grounded"))


def lowest_matches(spark, sf_dir):
    return metrics.lowest(best_matches(spark, sf_dir))


V = "v AS (SELECT vec_id AS id, embedding::double[] AS vec, label FROM embeddings)"
DOT = "round(list_inner_product(a.vec, b.vec), 5)"
TOP = f"{V}, s AS (SELECT a.id AS query_id, b.id AS id, {DOT} AS similarity FROM v a, v b WHERE a.id % 20 = 0), tk AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank, id, similarity FROM s QUALIFY rank <= 6)"
BEST = f"{V}, s AS (SELECT a.id AS query_id, b.id AS match_id, {DOT} AS similarity FROM v a, v b WHERE a.id % 2 = 0 AND b.id % 2 = 1), bm AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, match_id) = 1)"
LEADERS = f"""{V}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS n FROM v), ed AS (SELECT a.label, a.id AS a, b.id AS b FROM v a JOIN v b ON a.label = b.label AND a.id < b.id WHERE {DOT} >= {THRESHOLD}),
fold(label, n, id, leader, heads) AS (SELECT label, 0::bigint, NULL::bigint, NULL::bigint, []::bigint[] FROM (SELECT DISTINCT label FROM v)
  UNION ALL SELECT f.label, o.n, o.id, coalesce(h.l, o.id), CASE WHEN h.l IS NULL THEN list_append(f.heads, o.id) ELSE f.heads END FROM fold f JOIN o ON o.label = f.label AND o.n = f.n + 1
    LEFT JOIN (SELECT label, b, list(a ORDER BY a) AS xs FROM ed GROUP BY ALL) e ON e.label = o.label AND e.b = o.id, LATERAL (SELECT list_min(list_filter(coalesce(e.xs, []), lambda x: list_contains(f.heads, x))) AS l) h),
ld AS (SELECT label, id, leader FROM fold WHERE id IS NOT NULL)"""

QUERIES = {
    "topk_vectors": (topk_vectors, f"WITH {TOP} SELECT * FROM tk"),
    "search_format": (search_format, f"""WITH {TOP} SELECT query_id, string_agg('[Result ' || rank || '] Score: ' || format('{{:.3f}}', similarity) || chr(10) || 'Source: policy/' || (id % 9) || '.pdf, Page ' || (id % 5) || chr(10) || 'Text: passage ' || id || chr(10), chr(10) || '---' || chr(10) ORDER BY rank) AS text FROM tk GROUP BY ALL"""),
    "similar_pairs": (similar_pairs, f"WITH {V} SELECT a.id AS a, b.id AS b, {DOT} AS similarity FROM v a, v b WHERE a.id < b.id AND {DOT} >= {THRESHOLD}"),
    "similar_pairs_by_label": (similar_pairs_by_label, f"WITH {V} SELECT a.label, a.id AS a, b.id AS b, {DOT} AS similarity FROM v a, v b WHERE a.label = b.label AND a.id < b.id AND {DOT} >= {THRESHOLD}"),
    "dedupe_leaders": (dedupe_leaders, f"WITH RECURSIVE {LEADERS} SELECT * FROM ld"),
    "dedupe_merge": (dedupe_merge, f"""WITH RECURSIVE {LEADERS}, rq AS (SELECT vec_id AS id, 'Does the P&P state rule ' || (vec_id % 97) || '?' AS text, CASE WHEN vec_id % 3 <> 0 THEN 'APL ' || (vec_id % 4) END AS reference, CASE WHEN vec_id % 2 = 0 THEN 'Plan' END AS actor, CASE WHEN vec_id % 5 = 0 THEN '30 days' END AS timeframe FROM embeddings),
sc AS (SELECT rq.*, leader, length(text) + (actor IS NOT NULL)::int + (timeframe IS NOT NULL)::int AS score FROM rq JOIN ld USING (id)),
be AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY leader ORDER BY score DESC, id) = 1),
rf0 AS (SELECT leader, reference, min(id) AS f FROM sc WHERE reference IS NOT NULL GROUP BY ALL), rf AS (SELECT leader, string_agg(reference, '; ' ORDER BY f) AS refs FROM rf0 GROUP BY ALL), cn AS (SELECT leader, count(*) AS members FROM sc GROUP BY ALL)
SELECT leader AS id, text, actor, timeframe, CASE WHEN members > 1 THEN refs ELSE reference END AS reference, members FROM be JOIN cn USING (leader) LEFT JOIN rf USING (leader)"""),
    "best_matches": (best_matches, f"WITH {BEST} SELECT * FROM bm"),
    "semantic_recall": (semantic_recall, f"WITH {BEST} SELECT count(*) AS n, round(avg((similarity >= 0.3)::int), 6) AS recall, round(avg(similarity), 6) AS mean_similarity, round(median(similarity), 6) AS median_similarity, round(avg((similarity < 0.3)::int), 6) AS hallucination_rate FROM bm"),
    "hallucination": (hallucination, f"WITH {V}, s AS (SELECT a.id, max({DOT}) AS m FROM v a, v b WHERE a.id % 2 = 1 AND b.id % 2 = 0 GROUP BY ALL) SELECT count(*) FILTER (m < 0.3) AS unmatched, count(*) AS n FROM s"),
    "grounding": (grounding, f"WITH {BEST} SELECT query_id, match_id, greatest(0, similarity) AS score, similarity >= 0.5 AS grounded FROM bm"),
    "lowest_matches": (lowest_matches, f"WITH {BEST} SELECT query_id, match_id, similarity FROM bm ORDER BY similarity, query_id LIMIT 10"),
}
