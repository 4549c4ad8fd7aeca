"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, hnsw, mixing, pieces, quality, rules, warc, wrapper
from .common import table
from .near_dedup import near_duplicates


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = "<|im_end|><|im_start|>assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", same), (-1, 1, "assistant", same)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_turns(rows.unionByName(added)))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.count_tokens(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hnsw.search(hnsw.build_index(rows), rows.where("vec_id % 20 = 0"))


def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_quality_classifier, op3_html_extraction, op4_minhash_near_dedup, op5_quality_rules, op6_chat_formatting, op7_token_counts, op8_warc, op9_nearest_neighbours, op10_mixing_sources)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The pages of the tables hold one article each and name few character references.
OP3_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), ''), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
u AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM a)
SELECT page_id, url, text, length(text) AS n_chars FROM u"""

OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2])) WHEN len(ws) > 0 THEN [array_to_string(ws, chr(1))] ELSE [] END AS ss FROM w),
e AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
both_ AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, both_.b FROM r JOIN both_ ON both_.a = r.m)
SELECT doc_id, len(ss) AS n_shingles, c.component_id, doc_id = c.component_id AS kept FROM s JOIN (SELECT d, min(m) AS component_id FROM r GROUP BY d) c ON c.d = doc_id"""

OP6_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_start|><|im_sep|><|im_end|>'))::bigint AS formatted_chars
FROM t GROUP BY conv_id"""

#: Exact neighbours; in tables of the size that SQL can take, graphs miss none.
OP9_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score FROM g q JOIN g c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER w)::int AS rank, vec_id, score FROM p WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20"""

#: Five hex digits of the digest are four characters of base 32.
OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::bigint AS payload_bytes, b, sha1(b) AS h FROM p),
f AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || h[i * 5 + 1:i * 5 + 5])::int) AS v FROM d),
t AS (SELECT page_id, payload_bytes, b, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((x >> k) & 31) + 1]), '')), '') AS payload_digest, max(page_id) OVER (PARTITION BY b) AS head FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM head AND head IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to FROM t"""


def oracle_sql() -> dict[str, str]:
    return {"op3_html_extraction": OP3_SQL, "op4_minhash_near_dedup": OP4_SQL, "op6_chat_formatting": OP6_SQL, "op8_warc": OP8_SQL, "op9_nearest_neighbours": OP9_SQL}
