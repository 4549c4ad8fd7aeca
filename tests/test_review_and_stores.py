import json
import tracemalloc
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditloom import models, schemas
from auditloom.functions import llmjson
from auditloom.functions import text as X
from auditloom.operators import metrics, review, similarity
from auditloom.plans import compliance
from auditloom.sources import corpus, store
from auditloom.streaming import limiter
from auditloom.streaming import review as stream


def test_answers(spark):
    good = {"answer": "YES", "citation_text": "c", "source_file": "f", "page_number": 3, "confidence": 0.9, "reasoning": "r"}
    rows = {
        1: json.dumps(good), 2: "```json\n" + json.dumps(good) + "\n```", 3: json.dumps({**good, "page_number": None, "confidence": None, "citation_text": None}), 4: "not json", 5: json.dumps({**good, "answer": "maybe"}),
        6: json.dumps({**good, "confidence": 1.5}), 7: json.dumps({**good, "page_number": "n/a"}), 8: json.dumps({k: v for k, v in good.items() if k != "answer"}), 9: "", 10: json.dumps({**good, "page_number": 3.7}), 11: json.dumps({**good, "page_number": "3.7"})}
    got = {r.requirement_id: r for r in llmjson.answers(spark.createDataFrame(list(rows.items()), "requirement_id int, raw string")).collect()}
    assert [(got[i].answer, got[i].confidence, got[i].page_number, got[i].needs_human_review) for i in rows] == [
        ("yes", 0.9, 3, False), ("yes", 0.9, 3, False), ("yes", 0.0, 0, False), ("no", 0.0, 0, True), ("no", 0.0, 0, True), ("no", 0.0, 0, True), ("yes", 0.9, 0, False), ("no", 0.0, 0, True), ("no", 0.0, 0, True), ("yes", 0.9, 3, False), ("yes", 0.9, 0, False)]


def test_requirement_json(spark):
    raw = ['[{"id": 1, "text": "a"}]', '```\n[{"id": 1, "text": "a"}]\n```', 'Sure: [{"id": 1, "text": "a"}, 5, {"id": 2}] ok', "nothing", '{"id": 1}', "[]"]
    got = llmjson.requirements(spark.createDataFrame(list(enumerate(raw)), "k int, raw string")).collect()
    assert sorted((r.k, r.status, r.id, r.text) for r in got if r.status == "ok") == [(0, "ok", 1, "a"), (1, "ok", 1, "a"), (2, "ok", 1, "a")]
    assert {(r.k, r.status) for r in got if r.status != "ok"} == {(3, "not_json"), (4, "not_array")}


def test_critic(spark):
    ev = spark.createDataFrame([(1, 1, "no", "r", False), (2, 1, "no", "s", False), (3, 2, "yes", "t", True)], "seq int, requirement_id int, answer string, reasoning string, needs_human_review boolean")
    raw = spark.createDataFrame([(0, 'Well: [{"requirement_id": 1, "verified_answer": "Yes", "needs_human_review": true, "reason": "why"}, {"requirement_id": 9, "verified_answer": "no"}, {"requirement_id": 2, "verified_answer": "perhaps"}]')], "k int, raw string")
    got = {r.seq: (r.answer, r.reasoning, r.needs_human_review) for r in review.apply_verdicts(ev, llmjson.verdicts(raw)).collect()}
    assert got == {1: ("no", "r", False), 2: ("yes", "s [Critic: why]", True), 3: ("yes", "t", False)}


def test_schemas_and_helpers(spark):
    rows = [(1, "yes", 0.5, "pending"), (2, "yes", 1.5, "pending"), (3, "hm", 0.5, None), (None, "no", 0.5, None), (5, "no", None, None), (6, "no", 0.0, None)]
    good, bad = schemas.quarantine(spark.createDataFrame(rows, "requirement_id int, answer string, confidence double, status string"), schemas.valid_evaluation())
    assert {r.requirement_id for r in good.collect()} == {1, 6} and bad.count() == 4
    got = spark.range(1).select(X.progress_percent(F.lit(1), F.lit(8)).alias("a"), X.progress_percent(F.lit(0), F.lit(0)).alias("b"), X.confidence_tier(F.lit(0.8), F.lit(False)).alias("c"), X.confidence_tier(F.lit(0.9), F.lit(True)).alias("d"), X.coerced_int(F.lit("3.7")).alias("e"), X.coerced_int(F.lit(" 12 ")).alias("f")).first()
    assert tuple(got) == (13, 0, "green", "red", 0, 12)
    assert review.startable("extracting") and not review.startable("complete")


def unit(*xs):
    v = np.array(xs, dtype=float)
    return (v / np.linalg.norm(v)).tolist()


def test_leaders_are_not_transitive(spark, monkeypatch):
    rows = [(1, unit(1, 0)), (2, unit(0.93, 0.36)), (3, unit(0.7, 0.71)), (4, unit(0, 1))]
    for block in (1024, 1):
        monkeypatch.setattr(similarity, "BLOCK", block)
        v = spark.createDataFrame([(i, x, "k") for i, x in rows], "id long, vec array<double>, label string")
        assert {r.id: r.leader for r in similarity.leaders(v, 0.9).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
        assert {(r.a, r.b) for r in similarity.pairs(v.select("id", "vec"), 0.9).collect()} == {(1, 2), (2, 3)}


def test_leaders_of_copies(spark):
    rng = np.random.default_rng(5)
    distinct = [unit(*x) for x in rng.normal(size=(12, 2))] + [[0.0, 0.0]]
    rows = [(i, distinct[int(j)], k) for k in ("p", None) for i, j in enumerate(rng.integers(0, 13, 150))]
    v = spark.createDataFrame(rows, "id long, vec array<double>, label string")
    want = {}
    for k in ("p", None):
        mine = [(i, np.array(x)) for i, x, label in rows if label == k]
        for at, (i, x) in enumerate(mine):
            if want.setdefault((k, i), i) == i:
                for j, y in mine[at + 1 :]:
                    if round(float(x @ y), 5) >= 0.9:
                        want.setdefault((k, j), i)
    got = similarity.leaders(v, 0.9).collect()
    assert len(got) == len(rows) and {(r.label, r.id): r.leader for r in got if r.label} == {k: x for k, x in want.items() if k[0]}
    nulls = {r.id: r.leader for r in got if r.label is None}
    assert nulls == {i: x for (k, i), x in want.items() if k is None}
    assert similarity.leaders(v.limit(0), 0.9).collect() == []
    copies = spark.range(50_000).select("id", F.array(F.lit(0.6), F.lit(0.8)).alias("vec"), F.lit("k").alias("label"))
    assert [tuple(r) for r in similarity.leaders(copies).groupBy("leader").count().collect()] == [(0, 50_000)]


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 50)
    rng = np.random.default_rng(3)
    m = np.round(rng.normal(size=(230, 8)), 2)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, vec array<double>")
    got = {}
    for r in similarity.top_k(v.where("id < 70"), v, 5, drop_self=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    s = np.round(m @ m.T, 5)
    np.fill_diagonal(s, -np.inf)
    assert got == {q: sorted(range(230), key=lambda i: (-s[q, i], i))[:5] for q in range(70)}


def test_rows_of_a_large_key_are_not_copied(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    monkeypatch.setattr(similarity, "TILE", 7)
    monkeypatch.setattr(similarity, "BATCH", 5)
    m = np.random.default_rng(4).normal(size=(120, 3))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    keys = [("p", None, "few")[0 if i < 70 else 1 if i < 110 else 2] for i in range(120)]
    v = spark.createDataFrame([(i, x.tolist(), k) for i, (x, k) in enumerate(zip(m, keys, strict=True))], "id long, vec array<double>, label string")
    s = np.round(m @ m.T, 5)
    want = {(i, j): s[i, j] for i in range(120) for j in range(i + 1, 120) if s[i, j] >= 0.7}
    found = similarity.pairs(v.select("id", "vec"), 0.7)
    assert "vec" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.collect()
    assert len(rows) == len(want) and {(r.a, r.b): r.similarity for r in rows} == pytest.approx(want)
    rows = similarity.pairs(v, 0.7, "label").collect()
    assert sorted((r.label or "", r.a, r.b) for r in rows) == sorted((keys[i] or "", i, j) for i, j in want if keys[i] == keys[j])


def test_search_memory_is_bounded(spark):
    class Corpus:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return spark.createDataFrame([], schema)

    vectors = np.random.default_rng(6).normal(size=(40_000, 8))
    asked = spark.createDataFrame(pd.DataFrame({"id": range(1500), "vec": vectors[:1500].tolist()}), "id long, vec array<double>").coalesce(1)
    corpus_rows = Corpus()
    similarity.top_k(asked, corpus_rows, 3)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(40_000)), pa.ListArray.from_arrays(pa.array(np.arange(40_001, dtype=np.int32) * 8), pa.array(vectors.ravel()))], names=["id", "vec"])
    tracemalloc.start()
    found = pa.Table.from_batches(list(corpus_rows.run(iter([batch])))).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    top = found.sort_values(["query_id", "similarity", "id"], ascending=[True, False, True]).groupby("query_id").head(3)
    s = np.round(vectors[:1500] @ vectors.T, 5)
    assert top.similarity.to_numpy().reshape(-1, 3) == pytest.approx(-np.sort(-s, axis=1)[:, :3])


def test_search_and_citations(spark):
    texts = ["members receive care management services", "billing codes for claims", "appeals and grievances of members"]
    c = models.embed(spark.createDataFrame([(i, t, f"f{i}.pdf", i) for i, t in enumerate(texts)], "id long, text string, source_file string, page_number int"), "text")
    asked = spark.createDataFrame([(1, "care management services"), (2, "")], "id long, text string")
    got = {r.id: r.result for r in compliance.search(asked, c, 1).collect()}
    assert "Source: f0.pdf, Page 0" in got[1]
    assert compliance.search(asked, c.limit(0)).first().result.startswith("No relevant")
    rows = spark.createDataFrame([("care management", "care management"), ("care", "billing")], "requirement string, passage string")
    assert [r.verdict for r in compliance.evaluate_citation(rows).collect()] == ["yes", "no"]


def test_metrics(spark):
    best = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, 0.7), (4, 0.7)], "query_id long, similarity double")
    assert tuple(metrics.recall(best).first()) == (4, 0.75, 0.6, 0.7, 0.25)
    assert {r.metric: r.passed for r in metrics.report({"semantic_recall": 0.7, "fallback_rate": 0.3, "other": 1}, spark).collect()} == {"semantic_recall": True, "fallback_rate": False, "other": None}


def test_store(spark, tmp_path):
    t = store.Table(spark, f"file://{tmp_path}/t", schemas.struct("id string, payload string"), "id")
    assert t.count() == 0
    rows = spark.createDataFrame([("a", "1"), ("b", "1")], "id string, payload string")
    for _ in range(2):
        t.upsert(rows)
    t.upsert(spark.createDataFrame([("b", "2"), ("c", "2")], "id string, payload string"))
    assert {r.id: r.payload for r in t.read().collect()} == {"a": "1", "b": "2", "c": "2"}


def test_collections(spark, tmp_path):
    made = store.Collections(spark, f"file://{tmp_path}/c")
    spec = schemas.struct("id string, payload string")
    made.get("policies", spec, distance="cosine").upsert(spark.createDataFrame([("a", "1")], spec))
    made.get("terms", spec)
    again = store.Collections(spark, f"file://{tmp_path}/c")
    assert again.get("policies", spec).count() == 1 and again.get("terms", spec).count() == 0
    assert (again.distance("policies"), again.distance("terms"), again.distance("none")) == ("cosine", "l2", None)
    for distance in ("l2", "taxi"):
        with pytest.raises(ValueError, match="distance|none of"):
            again.get("policies", spec, distance=distance)
    one = spark.createDataFrame([(0.75,)], "s double").select(again.measure("policies", F.col("s")).alias("p"), again.measure("terms", F.col("s")).alias("t")).first()
    assert (one.p, one.t) == (0.25, 0.5)
    with pytest.raises(KeyError):
        again.measure("none", F.col("s"))


def test_store_merges_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store.Table, "PARTS", 3)
    spec = schemas.struct("id string, payload string")
    t = store.Table(spark, f"file://{tmp_path}/t", spec, "id")
    frame = lambda rows: spark.createDataFrame(rows, spec)
    want = {}
    for n, rewrite in enumerate((4, 4, 4, 0, 0, 0, 4, 4)):  # merged whole, then all but the first
        monkeypatch.setattr(store.Table, "REWRITE", rewrite)
        rows = [(None, f"{n}"), ("a", f"{n}"), (f"k{n % 3}", f"{n}"), (f"only{n}", f"{n}")]
        t.upsert(frame(rows))
        want |= dict(rows)
        assert {r.id: r.payload for r in t.read().collect()} == want and t.count() == len(want)
        assert len(t._live()) < 3
    held = t.read()
    before = {r.id: r.payload for r in held.collect()}
    assert t.vacuum() > 0 and t.vacuum() == 0
    assert {r.id: r.payload for r in t.read().collect()} == before
    t.upsert(frame([]))
    assert {r.id: r.payload for r in t.read().collect()} == before


def test_store_of_two_writers(spark, tmp_path, monkeypatch):
    spec = schemas.struct("id string, payload string")
    one, two = (store.Table(spark, f"file://{tmp_path}/t", spec, "id") for _ in range(2))
    one.upsert(spark.createDataFrame([("a", "0")], spec))
    seen = two._live()
    one.upsert(spark.createDataFrame([("b", "1")], spec))
    with monkeypatch.context() as m:
        m.setattr(two, "_live", lambda: seen)  # began before the other's rows were there
        two.upsert(spark.createDataFrame([("c", "2")], spec))
    assert {r.id: r.payload for r in one.read().collect()} == {"a": "0", "b": "1", "c": "2"}


def test_cache(spark, tmp_path):
    cache = store.Cache(spark, f"file://{tmp_path}/c")
    asked = spark.createDataFrame([("k1",), ("k2",)], "cache_key string")
    assert all(r.payload is None for r in cache.lookup(asked, "sections").collect())
    cache.put(spark.createDataFrame([("k1", "x")], "cache_key string, payload string"), "sections")
    assert {r.cache_key: r.payload for r in cache.lookup(asked, "sections").collect()} == {"k1": "x", "k2": None}
    assert all(r.payload is None for r in cache.lookup(asked, "other").collect())
    off = store.Cache(spark, f"file://{tmp_path}/c", enabled=False)
    assert all(r.payload is None for r in off.lookup(asked, "sections").collect())


def test_sessions(spark, tmp_path):
    s = store.Sessions(spark, f"file://{tmp_path}/s")
    with pytest.raises(ValueError, match="pdf"):
        s.upload("a.txt", "narrative", datetime(2024, 1, 1))
    k = s.upload("a.pdf", "narrative", datetime(2024, 1, 1))
    with pytest.raises(KeyError):
        s.get("nope")
    s.put(s.requirements, k, spark.createDataFrame([(2, "b", None, None), (1, "a", None, None)], schemas.REQUIREMENT), "id")
    s.set_status(k, "reviewing")
    with pytest.raises(ValueError, match="cannot"):
        s.set_status(k, "extracting")
    row = s.results(k).first()
    assert row.status == "reviewing" and [r.text for r in row.requirements] == ["a", "b"] and row.evaluations == []


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([(2, 'say "x", y', None), (1, "é\nb", "z")], "seq int, text string, note string")
    store.write_csv(rows, f"file://{tmp_path}/out", "seq")
    back = pd.read_csv(next(tmp_path.glob("out/part-*.csv")), keep_default_na=False)
    assert back.text.tolist() == ["é\nb", 'say "x", y'] and list(back.columns) == ["text", "note"]


def test_corpus_files(spark, tmp_path):
    for folder, name, raw in (("A", "one.pdf", b"p one\fp two\f  "), ("A", "bad.pdf", b"\xff\xfe"), ("B", "none.pdf", b" \f "), ("B", "x.txt", b"skip")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(raw)
    files = corpus.corpus_files(spark, str(tmp_path))
    assert sorted((r.folder, r.file) for r in files.collect()) == [("A", "bad.pdf"), ("A", "one.pdf"), ("B", "none.pdf")]
    parsed = corpus.parse_files(files)
    got = {(r.source_file, r.page_number, r.text, (r.error or "").split(":")[0]) for r in parsed.collect()}
    assert got == {("A/one.pdf", 1, "p one", ""), ("A/one.pdf", 2, "p two", ""), ("A/bad.pdf", None, None, "UnicodeDecodeError"), ("B/none.pdf", None, None, "no text")}
    stats = corpus.ingest_stats(parsed, spark.range(5)).first()
    assert (stats.files, stats.chunks, len(stats.errors)) == (1, 5, 2)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus.corpus_files(spark, f"{tmp_path}/missing").collect()


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.now += s


def test_token_bucket():
    c = Clock()
    b = limiter.TokenBucket(2.0, clock=c, sleep=c.sleep)
    assert [b.acquire() for _ in range(4)] == [0.0, 0.0, 0.5, 0.5]
    assert b.acquire(99) == pytest.approx(1.0)  # clamped to the capacity
    assert limiter.TokenBucket(0.5, clock=c, sleep=c.sleep).capacity == 1.0
    assert limiter.TokenBucket(0.0, clock=c, sleep=c.sleep).acquire(50) == 0.0
    assert limiter.shared(600, 5).rate == 2.0


def test_retries_and_timeouts():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise RuntimeError("503 UNAVAILABLE")
        return "ok"

    assert limiter.with_retries(flaky, lambda m: "503" in m, jitter=0, sleep=waits.append) == "ok" and waits == [4.0, 8.0, 16.0]
    with pytest.raises(RuntimeError, match="fatal"):
        limiter.with_retries(lambda: (_ for _ in ()).throw(RuntimeError("fatal")), lambda m: False)
    import time

    assert limiter.with_timeout(lambda: time.sleep(1), 0.05, "late") == "late" and limiter.with_timeout(lambda: 7, 5, "late") == 7


def test_progress_events():
    got = list(stream.progress_events([("parse", lambda: "10 pages"), ("boom", lambda: 1 / 0), ("never", lambda: "")]))
    assert [(e["type"], e["step"], e["step_number"]) for e in got] == [("extraction_progress", "parse", 1), ("extraction_error", "boom", 2)]
    assert [e["type"] for e in stream.progress_events([("a", lambda: "")])] == ["extraction_progress", "complete"]


def test_review_stream(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).toDF("requirement_id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("requirement_id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    reviewed, events = stream.review_stream(rows, lambda b: b.withColumn("confidence", F.lit(0.5)), lambda e: e.withColumn("flag", F.lit(True)), f"file://{tmp_path}/run")
    assert reviewed.count() == 30 and reviewed.where("flag").count() == 30
    kinds = [r.event for r in events.orderBy("seq").collect()]
    assert kinds == ["evaluation"] * 30 + ["progress", "critic_complete", "done"]
    first = json.loads(events.orderBy("seq").first().data)
    assert first["progress"] == 1 and first["total"] == 30
