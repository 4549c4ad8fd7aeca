"""Short documents by one call, their events, concurrent preparation, uploads and the mock stream."""

import json
import threading

import pytest

from auditloom import agents, schemas
from auditloom.operators import lines
from auditloom.plans import narrative
from auditloom.sources import corpus, store
from auditloom.streaming import review as stream

FAST = agents.Limits(workers=2, per_minute=0, seconds=20, attempts=1, base=0.01, jitter=0)
TEXT = "[PAGE 1]\n[HEADING 1] Duties\nThe plan must report.\nEnhanced Care Management (ECM) is nice. Staff should\nanswer!\n[HEADING 1] Glossary\nCare Plan: The written plan for one member."
TERM_ROWS = schemas.struct("id string, document string, term string, abbreviation string, definition string, source_file string, page_number int, section_heading string, source string")


class Client:
    def complete(self, prompt):
        body = prompt.split(narrative.MARK)[1]
        if "down" in body:
            raise RuntimeError("gone")
        if "prose" in body:
            return "I cannot"
        if "object" in body:
            return '{"id": 1}'
        return "Sure:\n" + json.dumps([{"id": 1, "text": "a"}, {"text": "no id"}, "x", {"id": 2, "text": "b", "category": "c"}])


def test_extract(spark):
    docs = spark.createDataFrame([(1, "fine"), (2, "down"), (3, "prose"), (4, "object"), (5, None)], "doc_id long, text string")
    got = {(r.doc_id, r.status, r.error, r.id, r.text, r.category) for r in narrative.extract(docs, Client(), FAST).collect()}
    items = lambda d: {(d, "ok", None, 1, "a", None), (d, "ok", None, 2, "b", "c")}
    assert got == items(1) | items(5) | {(2, "failed", "Agent error: gone", None, None, None), (3, "not_json", None, None, None, None), (4, "not_array", None, None, None, None)}
    assert narrative.extract(docs.limit(0), Client(), FAST).collect() == []
    assert narrative.extract(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string"), limits=FAST).where("id IS NOT NULL").isEmpty()


def test_events(spark, tmp_path):
    table = store.Table(spark, f"file://{tmp_path}/terms", TERM_ROWS, "id")
    seen = list(narrative.events(spark.createDataFrame([(1, TEXT)], "doc_id long, text string"), "a.pdf", table, limits=FAST))
    assert [(e["type"], e.get("step"), e.get("step_number")) for e in seen[:-1]] == [("progress", s, n) for n, s in enumerate(narrative.STEPS, 1)]
    assert seen[-1]["type"] == "complete" and seen[-1]["total_requirements"] == 2
    assert [(r["id"], r["text"], r["category"]) for r in seen[-1]["requirements"]] == [
        (1, "Does the P&P state that The plan must report?", "duty"), (2, "Does the P&P state that Staff should answer!?", "expectation")]
    assert {r.id for r in table.read().collect()} == {"a.pdf::ECM", "a.pdf::Care Plan"}


def test_events_that_fail(spark, tmp_path):
    class Broken(store.Table):
        def upsert(self, rows):
            raise OSError("disk")

    docs = lambda t: spark.createDataFrame([(1, t)], "doc_id long, text string")
    table = Broken(spark, f"file://{tmp_path}/terms", TERM_ROWS, "id")
    assert [e["type"] for e in narrative.events(docs(TEXT), "a.pdf", table, limits=FAST)] == ["progress"] * 5 + ["complete"]
    for text, why in (("down", "Agent error: gone"), ("prose", "the answer is not_json")):
        seen = list(narrative.events(docs(text), "a.pdf", table, Client(), FAST))
        assert [e["type"] for e in seen] == ["progress", "progress", "extraction_error"] and seen[-1]["error"] == why


def test_concurrently(spark):
    both = threading.Barrier(2, timeout=30)

    def job(n):
        both.wait()  # ends only where both run at once
        return spark.range(n)

    made = narrative.concurrently({"a": lambda: job(1), "b": lambda: job(2)})
    assert {k: v.count() for k, v in made.items()} == {"a": 1, "b": 2}
    with pytest.raises(ZeroDivisionError):
        narrative.concurrently({"a": lambda: spark.range(1), "b": lambda: 1 // 0})
    prepared = narrative.prepare(lines.to_lines(spark.createDataFrame([(1, TEXT), (2, "nothing")], "doc_id long, text string")))
    assert [tuple(r) for r in narrative.counts(prepared).orderBy("doc_id").select("doc_id", "n_sections", "n_kept", "n_skipped", "n_terms").collect()] == [(1, 2, 1, 1, 2), (2, 1, 0, 1, 0)]


def test_receive(spark, tmp_path):
    s = store.Sessions(spark, f"file://{tmp_path}/s")
    with pytest.raises(ValueError, match="pdf"):
        s.receive("a.txt", b"x")
    kinds = {"short.pdf": b"one\ftwo", "long.PDF": b"\f".join([b"page"] * 21), "blank.pdf": b" \f "}
    made = {name: s.receive(name, content, corpus.plain_text) for name, content in kinds.items()}
    assert {n: (m["doc_type"], m["extraction_status"]) for n, m in made.items()} == {
        "short.pdf": ("narrative", "processing"), "long.PDF": ("compliance", "processing"), "blank.pdf": ("narrative", "complete")}
    assert {n: s.get(m["session_id"]).first()["status"] for n, m in made.items()} == {"short.pdf": "extracting", "long.PDF": "extracting", "blank.pdf": "reviewing"}
    assert bytes(s.document(made["short.pdf"]["session_id"]).first()["content"]) == b"one\ftwo"
    before = sorted(tmp_path.glob("s/uploads/*.pdf"))
    with pytest.raises(ValueError, match="could not process bad.pdf"):
        s.receive("bad.pdf", b"\xff\xfe", corpus.plain_text)
    assert sorted(tmp_path.glob("s/uploads/*.pdf")) == before and s.sessions.count() == 3
    with pytest.raises(KeyError):
        s.document("nope")


def test_mock_stream(spark):
    rows = spark.createDataFrame([(3, "no"), (1, "yes"), (2, "partial")], "requirement_id int, answer string")
    seen = []
    assert stream.mock_stream(rows, seen.append, period="100 milliseconds") == 3
    assert [(e["completed"], e["total"], e["evaluation"]["requirement_id"]) for e in seen[:3]] == [(1, 3, 1), (2, 3, 2), (3, 3, 3)]
    assert [e["phase"] for e in seen[3:]] == ["critic", "complete"]
    assert stream.mock_stream(rows.limit(0), seen.append) == 0
    with pytest.raises(Exception, match="stop here"):
        stream.mock_stream(rows, lambda e: (_ for _ in ()).throw(RuntimeError("stop here")), period="100 milliseconds")
