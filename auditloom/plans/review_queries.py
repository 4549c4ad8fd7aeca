"""Queries over evaluations derived from orders, and over model answers in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import llmjson
from ..functions import text as X
from ..operators import metrics, review
from ..sources.shared import read_table

N_REQUIREMENTS = 64


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders")


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as requirements, from 3: the first two that evaluations name are missing."""
    part = read_table(spark, sf_dir, "part")
    return part.select((F.col("p_partkey") + 2).cast("int").alias("id"), F.concat(F.lit("Does the P&P cover "), "p_name", F.lit("?")).alias("text"), F.concat(F.lit("APL "), F.col("p_size").cast("string")).alias("reference"), F.col("p_type").alias("category"))


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One per order, seq by key; requirement, answer and confidence from the order."""
    o = _orders(spark, sf_dir)
    answer = F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "no").otherwise("partial")
    status = F.when(F.col("o_orderpriority").startswith("1"), "approved").when(F.col("o_orderpriority").startswith("5"), "rejected").otherwise("pending")
    source = F.when(F.col("o_orderkey") % 13 == 0, "").otherwise(F.concat(F.lit("policy/"), (F.col("o_custkey") % 50).cast("string"), F.lit(".pdf")))
    return o.select(
        F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % N_REQUIREMENTS + 1).cast("int").alias("requirement_id"), answer.alias("answer"), F.concat(F.lit("quote "), F.col("o_orderkey").cast("string")).alias("citation_text"), source.alias("source_file"),
        (F.col("o_orderkey") % 30).cast("int").alias("page_number"), ((F.col("o_orderkey") % 101) / 100.0).alias("confidence"), F.lit("found").alias("reasoning"), (F.col("o_orderkey") % 7 == 0).alias("needs_human_review"), status.alias("status"), F.lit("").alias("reviewer_notes"))


REQ_SQL = "req AS (SELECT (p_partkey + 2)::int AS id, 'Does the P&P cover ' || p_name || '?' AS text, 'APL ' || p_size AS reference, p_type AS category FROM part)"
EV_SQL = f"""ev AS (SELECT o_orderkey AS seq, (o_orderkey % {N_REQUIREMENTS} + 1)::int AS requirement_id, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' ELSE 'partial' END AS answer, 'quote ' || o_orderkey AS citation_text,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'policy/' || (o_custkey % 50) || '.pdf' END AS source_file, (o_orderkey % 30)::int AS page_number, (o_orderkey % 101) / 100.0::double AS confidence, 'found' AS reasoning, o_orderkey % 7 = 0 AS needs_human_review,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'approved' WHEN o_orderpriority LIKE '5%' THEN 'rejected' ELSE 'pending' END AS status, '' AS reviewer_notes FROM orders)"""
WITH = f"WITH {REQ_SQL}, {EV_SQL}"


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two verdicts for each of some requirements, one unknown id and one odd answer among them."""
    rows = [(i, i + 1000 * k, answer, bool((i + k) % 2), f"reason {i}.{k}") for i in range(1, 70, 3) for k, answer in enumerate(("YES" if i % 2 else "maybe", "partial"))]
    return spark.createDataFrame(rows, "requirement_id int, seq int, verified_answer string, needs_human_review boolean, reason string")


VERDICTS_SQL = "vd AS (SELECT i AS requirement_id, k, CASE WHEN k = 1 THEN 'partial' WHEN i % 2 = 1 THEN 'yes' ELSE 'maybe' END AS va, (i + k) % 2 = 1 AS fl, 'reason ' || i || '.' || k AS rs FROM range(1, 70, 3) a(i), range(2) b(k))"


def critic_select(spark, sf_dir):
    return review.low_confidence(evaluations(spark, sf_dir), requirements(spark, sf_dir))


def critic_apply(spark, sf_dir):
    return review.apply_verdicts(evaluations(spark, sf_dir), verdicts(spark, sf_dir)).select("seq", "requirement_id", "answer", "reasoning", "needs_human_review")


def sparse_patch(spark, sf_dir):
    ev = evaluations(spark, sf_dir)
    patches = ev.where("seq % 5 = 0").select("seq", F.when(F.col("seq") % 10 == 0, "yes").alias("answer"), F.lit(None).cast("double").alias("confidence"), F.concat(F.lit("note "), F.col("seq").cast("string")).alias("reviewer_notes"))
    return review.patch(ev, patches, ["seq"]).select("seq", "answer", "confidence", "reviewer_notes", "status")


def reviewer_edits(spark, sf_dir):
    ev = evaluations(spark, sf_dir)
    edits = ev.where("seq % 3 = 0").select("seq", F.element_at(F.array(F.lit("approve"), F.lit("edit"), F.lit("reject")), (F.col("seq") / 3 % 3 + 1).cast("int")).alias("action"), F.lit("partial").alias("answer"), F.lit("new quote").alias("citation_text"), F.when(F.col("seq") % 2 == 0, "  ").otherwise("because").alias("notes"))
    return review.patch(ev, review.edit_patch(edits), ["seq"]).select("seq", "answer", "citation_text", "status", "reviewer_notes")


def bulk_approve(spark, sf_dir):
    ids = spark.createDataFrame([(2,), (4,), (4,), (999,)], "requirement_id int")
    return review.bulk_status(evaluations(spark, sf_dir), ids).select("seq", "status", "touched")


def approvable(spark, sf_dir):
    return review.approvable(evaluations(spark, sf_dir)).select("seq", "confidence")


def fallbacks(spark, sf_dir):
    return review.fallbacks(evaluations(spark, sf_dir)).select("seq")


def validation(spark, sf_dir):
    """Valid and quarantined rows, some of them spoilt."""
    ev = evaluations(spark, sf_dir)
    spoilt = ev.withColumn("confidence", F.when(F.col("seq") % 9 == 0, 1.5).otherwise(F.col("confidence"))).withColumn("answer", F.when(F.col("seq") % 11 == 0, "unsure").otherwise(F.col("answer")))
    good, bad = schemas.quarantine(spoilt, schemas.valid_evaluation())
    return good.select("seq", F.lit("valid").alias("kind")).unionByName(bad.select("seq", F.lit("quarantined").alias("kind")))


def integrity(spark, sf_dir):
    return review.orphans(evaluations(spark, sf_dir), requirements(spark, sf_dir)).select("seq", "requirement_id")


def export_rows(spark, sf_dir):
    return review.export_rows(evaluations(spark, sf_dir), requirements(spark, sf_dir))


def display_rows(spark, sf_dir):
    return review.display_rows(requirements(spark, sf_dir), evaluations(spark, sf_dir))


def tiers(spark, sf_dir):
    return evaluations(spark, sf_dir).groupBy(X.confidence_tier(F.col("confidence"), F.col("needs_human_review")).alias("tier")).agg(F.count("*").alias("n"))


def progress_pct(spark, sf_dir):
    """Running count of each requirement's evaluations and its share."""
    w = review.Window.partitionBy("requirement_id")
    ev = evaluations(spark, sf_dir).withColumn("done", F.row_number().over(w.orderBy("seq"))).withColumn("total", F.count("*").over(w))
    return ev.select("seq", "done", X.progress_percent(F.col("done"), F.col("total")).alias("percent"))


def rates(spark, sf_dir):
    ev = evaluations(spark, sf_dir)
    return metrics.rates(ev, {"with_source": F.col("source_file") != "", "answered_yes": F.col("answer") == "yes", "flagged": F.col("needs_human_review"), "fallback": F.col("needs_human_review") & (F.col("confidence") == 0) & (F.col("source_file") == "")})


def uniqueness(spark, sf_dir):
    return metrics.uniqueness(evaluations(spark, sf_dir), "requirement_id")


def duplicate_ids(spark, sf_dir):
    return metrics.duplicates(evaluations(spark, sf_dir), "requirement_id")


def answer_distribution(spark, sf_dir):
    return metrics.answer_distribution(evaluations(spark, sf_dir).where("answer <> 'partial'"))


def count_variance(spark, sf_dir):
    ev = evaluations(spark, sf_dir)
    return metrics.count_variance(ev, ev.where("seq % 10 <> 0"))


def transient_errors(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    message = F.concat(F.lit("error "), (F.col("event_id") % 600).cast("string"), F.when(F.col("event_id") % 4 == 0, " Quota hit").otherwise(" other"))
    return e.select("event_id", X.transient(message).alias("transient"), X.transient_agent(message).alias("transient_agent"))


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent answers as text: every 7th fenced, every 11th broken, with odd values among them."""
    k = F.col("seq")
    ev = evaluations(spark, sf_dir)
    number = F.when(k % 6 == 0, "null").when(k % 6 == 1, F.concat(F.lit('"'), F.col("page_number").cast("string"), F.lit('"'))).when(k % 6 == 2, '"n/a"').otherwise(F.col("page_number").cast("string"))
    confidence = F.when(k % 8 == 0, "null").when(k % 17 == 0, "1.5").otherwise(F.format_string("0.%02d", (k % 100).cast("int")))
    answer = F.when(k % 3 == 0, F.upper("answer")).when(k % 19 == 0, "unsure").otherwise(F.col("answer"))
    body = F.concat(F.lit('{"answer": "'), answer, F.lit('", "citation_text": "'), "citation_text", F.lit('", "page_number": '), number, F.lit(', "confidence": '), confidence, F.when(k % 5 == 0, F.lit(', "reasoning": null')).otherwise(F.lit("")), F.lit("}"))
    broken = F.when(k % 11 == 0, F.regexp_replace(body, r"\}$", "")).otherwise(body)
    fenced = F.when(k % 7 == 0, F.concat(F.lit("```json\n"), broken, F.lit("\n```"))).otherwise(broken)
    return ev.select(k.alias("requirement_id"), fenced.alias("raw"))


def parse_answers(spark, sf_dir):
    return llmjson.answers(raw_answers(spark, sf_dir))


_NUM = "CASE WHEN seq % 6 IN (0, 2) THEN 0 ELSE page_number END"
_CONF = "CASE WHEN seq % 8 = 0 THEN 0.0 WHEN seq % 17 = 0 THEN 1.5 ELSE (seq % 100) / 100.0 END"
_GOOD = f"(seq % 11 <> 0 AND NOT (seq % 3 <> 0 AND seq % 19 = 0) AND {_CONF} <= 1)"


def parse_requirement_json(spark, sf_dir):
    k = F.col("seq")
    item = F.format_string('{"id": %d, "text": "t%d", "reference": null}', k, k)
    array = F.concat(F.lit("["), item, F.lit(', {"id": "x", "text": "bad id"}, {"id": 7}, '), F.format_string('{"id": "%d", "text": "second", "category": "c"}', k + 1), F.lit("]"))
    raw = F.when(k % 4 == 0, F.concat(F.lit("Here: "), array, F.lit(" done."))).when(k % 4 == 1, F.concat(F.lit("```json\n"), array, F.lit("\n```"))).when(k % 4 == 2, array).otherwise(F.when(k % 8 == 3, "no json").otherwise('{"a": 1}'))
    return llmjson.requirements(evaluations(spark, sf_dir).select(k, raw.alias("raw"))).drop("item_no")


def parse_compliance_json(spark, sf_dir):
    k = F.col("seq")
    array = F.format_string('[{"text": "t%d", "actor": "Plan", "timeframe": "30 days"}, {"actor": "nobody"}, {"text": "own", "section_heading": "Own"}]', k)
    raw = F.when(k % 3 == 0, "broken [").when(k % 3 == 1, array).otherwise(F.concat(F.lit("x "), array))
    rows = evaluations(spark, sf_dir).select("seq", F.lit("Default").alias("section_heading"), raw.alias("raw"))
    return llmjson.compliance(rows).select("seq", "item_no", "id", "text", "actor", "timeframe", "section_heading")


def parse_critic_json(spark, sf_dir):
    k = F.col("seq")
    array = F.format_string('[{"requirement_id": %d, "verified_answer": "yes", "needs_human_review": true, "reason": "r"}, {"requirement_id": "9", "verified_answer": "no"}, {"requirement_id": 8, "verified_answer": "no", "needs_human_review": "false"}]', k)
    raw = F.when(k % 5 == 0, array).when(k % 5 == 1, F.concat(F.lit("Sure.\n```json\n"), array, F.lit("\n``` bye"))).when(k % 5 == 2, F.concat(F.lit('{"n": 2, "verdicts": '), array, F.lit("}"))).when(k % 5 == 3, F.concat(F.lit("So: "), array, F.lit(" and [1]"))).otherwise("nothing here")
    return llmjson.verdicts(evaluations(spark, sf_dir).select("seq", raw.alias("raw")).withColumnRenamed("seq", "review_id"))


def parse_batch_json(spark, sf_dir):
    k = F.col("seq")
    sections = spark.createDataFrame([(b, s, h) for b in range(3) for s, h in enumerate(("Intake", "Intake", "Care Coordination", "Appeals"))], "batch_no long, section_no int, heading string")
    raw = F.format_string('{"sections": [{"heading": "INTAKE", "requirements": [{"text": "a", "actor": "Plan"}]}, {"heading": "Coordination", "requirements": [{"text": "b%d"}, {"actor": "x"}]}, {"heading": "Unknown", "requirements": [{"text": "c"}]}, {"heading": "Appeals and Grievances", "requirements": [{"text": "d", "timeframe": "9 days"}]}, {"heading": " Intake ", "requirements": [{"text": "e"}]}, {"heading": "The Intake of Members", "requirements": [{"text": "f"}]}]}', k)
    return llmjson.batch(evaluations(spark, sf_dir).select((k % 3).alias("batch_no"), raw.alias("raw")), sections)


QUERIES = {
    "critic_select": (critic_select, f"{WITH} SELECT requirement_id, coalesce(text, '(unknown)') AS requirement_text, answer AS agent_answer, citation_text AS citation, source_file AS source, confidence FROM ev LEFT JOIN req ON id = requirement_id WHERE confidence < 0.7"),
    "critic_apply": (critic_apply, f"""{WITH}, {VERDICTS_SQL}, la AS (SELECT *, row_number() OVER (PARTITION BY requirement_id ORDER BY seq DESC) = 1 AS lst FROM ev),
p AS (SELECT la.*, a.va AS v0, a.rs AS r0, b.va AS v1, b.rs AS r1, b.fl AS f1, lst AND b.va IS NOT NULL AS hit FROM la LEFT JOIN vd a ON a.requirement_id = la.requirement_id AND a.k = 0 LEFT JOIN vd b ON b.requirement_id = la.requirement_id AND b.k = 1),
q AS (SELECT *, CASE WHEN hit AND v0 IN ('yes', 'no', 'partial') THEN v0 ELSE answer END AS a0 FROM p)
SELECT seq, requirement_id, CASE WHEN hit THEN v1 ELSE answer END AS answer, reasoning || CASE WHEN hit AND a0 <> answer THEN ' [Critic: ' || r0 || ']' ELSE '' END || CASE WHEN hit AND v1 <> a0 THEN ' [Critic: ' || r1 || ']' ELSE '' END AS reasoning, CASE WHEN hit THEN f1 ELSE needs_human_review END AS needs_human_review FROM q"""),
    "sparse_patch": (sparse_patch, f"{WITH} SELECT seq, CASE WHEN seq % 10 = 0 THEN 'yes' ELSE answer END AS answer, confidence, CASE WHEN seq % 5 = 0 THEN 'note ' || seq ELSE reviewer_notes END AS reviewer_notes, status FROM ev"),
    "reviewer_edits": (reviewer_edits, f"""{WITH}, a AS (SELECT *, CASE WHEN seq % 3 <> 0 THEN '' WHEN seq // 3 % 3 = 0 THEN 'approve' WHEN seq // 3 % 3 = 1 THEN 'edit' WHEN seq % 2 = 1 THEN 'reject' ELSE '' END AS act FROM ev)
SELECT seq, CASE act WHEN 'edit' THEN 'partial' ELSE answer END AS answer, CASE act WHEN 'edit' THEN 'new quote' ELSE citation_text END AS citation_text, CASE act WHEN 'approve' THEN 'approved' WHEN 'edit' THEN 'edited' WHEN 'reject' THEN 'rejected' ELSE status END AS status, CASE WHEN act = 'reject' THEN 'because' WHEN act = 'edit' THEN CASE WHEN seq % 2 = 0 THEN '  ' ELSE 'because' END ELSE reviewer_notes END AS reviewer_notes FROM a"""),
    "bulk_approve": (bulk_approve, f"{WITH} SELECT seq, CASE WHEN requirement_id IN (2, 4) THEN 'approved' ELSE status END AS status, requirement_id IN (2, 4) AS touched FROM ev"),
    "approvable": (approvable, f"{WITH} SELECT seq, confidence FROM ev WHERE confidence >= 0.8 AND NOT needs_human_review AND status <> 'approved'"),
    "fallbacks": (fallbacks, f"{WITH} SELECT seq FROM ev WHERE needs_human_review AND confidence = 0 AND source_file = ''"),
    "validation": (validation, f"{WITH} SELECT seq, CASE WHEN seq % 9 = 0 OR seq % 11 = 0 THEN 'quarantined' ELSE 'valid' END AS kind FROM ev"),
    "integrity": (integrity, f"{WITH} SELECT seq, requirement_id FROM ev WHERE requirement_id NOT IN (SELECT id FROM req)"),
    "export_rows": (export_rows, f"{WITH} SELECT seq, requirement_id, coalesce(text, '') AS requirement_text, coalesce(reference, '') AS reference, answer, confidence, citation_text, source_file, page_number, needs_human_review, status, reviewer_notes, reasoning FROM ev LEFT JOIN req ON id = requirement_id"),
    "display_rows": (display_rows, f"""{WITH}, la AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY requirement_id ORDER BY seq DESC) = 1)
SELECT id, text, reference, coalesce(answer, '') AS answer, coalesce(floor(confidence * 100 + 0.5)::int || '%', '') AS confidence_text, coalesce(citation_text, '') AS citation_text, coalesce(status, 'pending') AS status, CASE WHEN confidence IS NULL THEN NULL WHEN needs_human_review OR confidence < 0.5 THEN 'red' WHEN confidence < 0.8 THEN 'yellow' ELSE 'green' END AS tier FROM req LEFT JOIN la ON requirement_id = id"""),
    "tiers": (tiers, f"{WITH} SELECT CASE WHEN needs_human_review OR confidence < 0.5 THEN 'red' WHEN confidence < 0.8 THEN 'yellow' ELSE 'green' END AS tier, count(*) AS n FROM ev GROUP BY ALL"),
    "progress_pct": (progress_pct, f"{WITH}, d AS (SELECT seq, row_number() OVER (PARTITION BY requirement_id ORDER BY seq) AS done, count(*) OVER (PARTITION BY requirement_id) AS total FROM ev) SELECT seq, done, floor(100.0 * done / total + 0.5)::int AS percent FROM d"),
    "rates": (rates, f"{WITH} SELECT round(avg((source_file <> '')::int), 6) AS with_source, round(avg((answer = 'yes')::int), 6) AS answered_yes, round(avg(needs_human_review::int), 6) AS flagged, round(avg((needs_human_review AND confidence = 0 AND source_file = '')::int), 6) AS fallback FROM ev"),
    "uniqueness": (uniqueness, f"{WITH} SELECT count(*) AS n, count(DISTINCT requirement_id) AS n_distinct, round(count(DISTINCT requirement_id) / count(*), 6) AS uniqueness FROM ev"),
    "duplicate_ids": (duplicate_ids, f"{WITH} SELECT requirement_id, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) > 1"),
    "answer_distribution": (answer_distribution, f"{WITH} SELECT a AS answer, count(seq) AS n, coalesce(round(avg(confidence), 6), 0) AS mean_confidence FROM (VALUES ('yes'), ('no'), ('partial')) v(a) LEFT JOIN ev ON answer = a AND answer <> 'partial' GROUP BY ALL"),
    "count_variance": (count_variance, f"{WITH} SELECT count(*) FILTER (seq % 10 <> 0) AS fewer, count(*) AS more, round((count(*) - count(*) FILTER (seq % 10 <> 0)) / count(*), 6) AS variance FROM ev"),
    "transient_errors": (transient_errors, "WITH m AS (SELECT event_id, 'error ' || (event_id % 600) || CASE WHEN event_id % 4 = 0 THEN ' Quota hit' ELSE ' other' END AS t FROM events) SELECT event_id, regexp_matches(upper(t), '503|429|QUOTA') AS transient, regexp_matches(t, '503') AS transient_agent FROM m"),
    "parse_answers": (parse_answers, f"""{WITH} SELECT seq AS requirement_id, CASE WHEN {_GOOD} THEN answer ELSE 'no' END AS answer, CASE WHEN {_GOOD} THEN citation_text ELSE '' END AS citation_text, '' AS source_file, CASE WHEN {_GOOD} THEN {_NUM} ELSE 0 END AS page_number, CASE WHEN {_GOOD} THEN {_CONF} ELSE 0 END::double AS confidence, CASE WHEN {_GOOD} THEN '' WHEN seq % 11 = 0 THEN 'Parse error: not JSON' WHEN seq % 3 <> 0 AND seq % 19 = 0 THEN 'Parse error: ''unsure'' is no answer' ELSE 'Parse error: confidence is not between 0 and 1' END AS reasoning, NOT {_GOOD} AS needs_human_review FROM ev"""),
    "parse_requirement_json": (parse_requirement_json, f"""{WITH}, r AS (SELECT seq FROM ev) SELECT seq, 'ok' AS status, seq::int AS id, 't' || seq AS text, NULL::varchar AS reference, NULL::varchar AS category FROM r WHERE seq % 4 < 3
UNION ALL SELECT seq, 'ok', (seq + 1)::int, 'second', NULL, 'c' FROM r WHERE seq % 4 < 3 UNION ALL SELECT seq, CASE WHEN seq % 8 = 3 THEN 'not_json' ELSE 'not_array' END, NULL, NULL, NULL, NULL FROM r WHERE seq % 4 = 3"""),
    "parse_compliance_json": (parse_compliance_json, f"{WITH} SELECT seq, 0 AS item_no, 0 AS id, 't' || seq AS text, 'Plan' AS actor, '30 days' AS timeframe, 'Default' AS section_heading FROM ev WHERE seq % 3 > 0 UNION ALL SELECT seq, 2, 0, 'own', NULL, NULL, 'Own' FROM ev WHERE seq % 3 > 0"),
    "parse_critic_json": (parse_critic_json, f"{WITH} SELECT seq AS review_id, 0 AS seq, seq::int AS requirement_id, 'yes' AS verified_answer, true AS needs_human_review, 'r' AS reason FROM ev WHERE seq % 5 < 4 UNION ALL SELECT seq, 1, NULL, 'no', false, NULL FROM ev WHERE seq % 5 < 4 UNION ALL SELECT seq, 2, 8, 'no', true, NULL FROM ev WHERE seq % 5 < 4".replace("SELECT seq AS review_id, 0 AS seq, seq::int", "SELECT ev.seq AS review_id, 0 AS seq, ev.seq::int")),
    "parse_batch_json": (parse_batch_json, f"""{WITH}, b AS (SELECT seq % 3 AS batch_no, seq AS s FROM ev) SELECT batch_no, 1 AS answer_no, 0 AS item_no, 2 AS section_no, 'Care Coordination' AS section_heading, 'b' || s AS text, NULL::varchar AS actor, NULL::varchar AS timeframe FROM b
UNION ALL SELECT batch_no, unnest([4, 5]), 0, 1, 'Intake', unnest(['e', 'f']), NULL, NULL FROM b UNION ALL SELECT batch_no, 3, 0, 3, 'Appeals', 'd', NULL, '9 days' FROM b"""),
}
