"""Model calls under limits, with fake clients."""

import json
import time

from auditloom import agents, models
from auditloom.operators import lines, terms
from auditloom.plans import compliance

FAST = agents.Limits(workers=4, per_minute=0, seconds=5, attempts=3, base=0.01, jitter=0)


class Fake:
    """Answers by what the prompt says; `busy` fails twice with a transient error, `down` always, `broken` for good."""

    def complete(self, prompt):
        if "slow" in prompt:
            time.sleep(3)
        if "busy" in prompt:
            self.seen = getattr(self, "seen", 0) + 1
            if self.seen < 3:
                raise RuntimeError("503 UNAVAILABLE")
        if "down" in prompt:
            raise RuntimeError("429 RESOURCE_EXHAUSTED")
        if "broken" in prompt:
            raise ValueError("no such model")
        return '```json\n{"answer": "Yes", "confidence": 0.9, "citation_text": "c", "source_file": "f", "page_number": 3, "reasoning": "ok"}\n```'


def test_evaluate_under_limits(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(("plain", "slow one", "busy", "down", "broken", None))], "requirement_id int, prompt string").coalesce(1)
    limits = agents.Limits(workers=4, per_minute=0, seconds=1, attempts=3, base=0.01, jitter=0)
    got = {r.requirement_id: (r.answer, r.confidence, r.reasoning, r.needs_human_review) for r in agents.evaluate(rows, Fake(), limits).collect()}
    good, bad = ("yes", 0.9, "ok", False), lambda why: ("no", 0.0, why, True)
    assert got == {0: good, 1: bad("Worker error: Worker timed out after 1s"), 2: good, 3: bad("Agent error: 429 RESOURCE_EXHAUSTED"), 4: bad("Agent error: no such model"), 5: good}
    seen = []
    assert agents.each(agents.evaluate(rows.limit(2), Fake(), FAST), seen.append) == 2 and {r.requirement_id for r in seen} == {0, 1}


class Sections:
    def complete(self, prompt):
        if "[SECTION_START" in prompt:
            heads = [p.split("'")[1] for p in prompt.split("[SECTION_START heading=")[1:]]
            return json.dumps({"sections": [{"heading": h, "requirements": [{"text": f"from {h}"}]} for h in heads]})
        if "Bad" in prompt:
            raise RuntimeError("nothing")
        return '[{"text": "must report", "actor": "Plan"}]'


def test_section_calls(spark):
    text = "[HEADING 1] Good\nThe plan must report.\n[HEADING 1] Bad\nThe plan must fail.\n[HEADING 1] Third\nStaff shall keep."
    s = lines.merge_empty(lines.segment(lines.to_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))))
    s = s.where("heading <> 'Preamble'")
    got = agents.extract(s, Sections(), FAST).collect()
    assert sorted((r.section_heading, r.text, r.actor) for r in got) == [("Good", "must report", "Plan"), ("Third", "must report", "Plan")]
    batched = agents.extract_batches(s, Sections(), FAST).collect()
    assert sorted((r.doc_id, r.section_heading, r.text) for r in batched) == [(1, h, f"from {h}") for h in ("Bad", "Good", "Third")]


class Critic:
    def complete(self, prompt):
        items = json.loads(prompt[prompt.index("[") :])
        return json.dumps([{"requirement_id": i["requirement_id"], "verified_answer": "PARTIAL", "needs_human_review": True, "reason": "thin"} for i in items])


def test_critic_call(spark):
    ev = spark.createDataFrame([(1, 1, "yes", 0.9, "a", False, "", ""), (2, 2, "yes", 0.2, "b", False, "", ""), (3, 3, "partial", 0.1, "c", False, "", "")], "seq int, requirement_id int, answer string, confidence double, reasoning string, needs_human_review boolean, citation_text string, source_file string")
    req = spark.createDataFrame([(1, "q1"), (2, "q2")], "id int, text string")
    got = {r.requirement_id: (r.answer, r.reasoning, r.needs_human_review) for r in agents.criticise(ev, req, Critic(), FAST, size=1).collect()}
    assert got == {1: ("yes", "a", False), 2: ("partial", "b [Critic: thin]", True), 3: ("partial", "c", True)}

    class Down:
        def complete(self, prompt):
            raise RuntimeError("gone")

    assert {r.requirement_id: r.answer for r in agents.criticise(ev, req, Down(), FAST).collect()} == {1: "yes", 2: "yes", 3: "partial"}


class Steps:
    """Looks a term up, errs once, then answers with what it was told."""

    def complete(self, prompt):
        if "[define_term]" not in prompt:
            return '{"tool": "define_term", "arguments": {"term": "ECM"}}'
        if "[search]" not in prompt:
            return '{"tool": "search", "arguments": {"wrong": 1}}'
        return json.dumps({"final_answer": {"answer": "yes", "reasoning": prompt.split("]\n", 1)[1]}})


def test_tool_loop():
    tools = {"define_term": lambda term: f"{term} is care", "search": lambda query: "x"}
    said = json.loads(agents.run_steps(Steps(), "task", tools))
    assert said["answer"] == "yes" and "ECM is care" in said["reasoning"] and "Error: TypeError" in said["reasoning"]
    try:
        agents.run_steps(Steps(), "task", tools, max_steps=2)
    except RuntimeError as e:
        assert "2 steps" in str(e)
    else:
        raise AssertionError
    assert agents.Agent(Steps(), tools).complete("task") and agents.run_steps(type("Plain", (), {"complete": lambda self, p: "free text"})(), "t", {}) == "free text"


def test_definitions_fall_back_to_the_nearest(spark):
    rows = [(1, "Enhanced Care Management", "ECM", "Whole person care for members", "a.pdf", 2, "Glossary"), (1, "Outreach", None, "Contact made to engage a member", "a.pdf", 3, None)]
    known = terms.term_rows(spark.createDataFrame(rows, "doc_id long, term string, abbreviation string, definition string, source_file string, page_number int, section_heading string"))
    asked = spark.createDataFrame([("ecm",), ("Outreach",), ("contact member engage",)], "query string")
    got = {r["query"]: r.result for r in compliance.define_terms(asked, known, 1).collect()}
    ecm = "[Enhanced Care Management (ECM)]\nDefinition: Whole person care for members\nSource: Glossary — a.pdf, page 2"
    out = "[Outreach]\nDefinition: Contact made to engage a member\nSource: a.pdf, page 3"
    assert got == {"ecm": ecm, "Outreach": out, "contact member engage": out}
    assert compliance.define_terms(asked.limit(1), known.limit(0)).first().result == "No definition found for 'ecm'."


def test_tables_without_requirement_column_go_to_the_extractor(spark):
    text = "[HEADING 2] Times\n[TABLE]\n| Step | Rule |\n| Intake | The plan must answer within 5 days |\n| Note | Nothing asked |\n[/TABLE]\n[TABLE]\n| Control | Owner |\n| keep a log | Quality |\n[/TABLE]"
    got = compliance.extract(lines.to_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))).orderBy("id").collect()
    assert [(r.exact_quote, r.actor, r.timeframe, r.obligation_type) for r in got] == [("Intake, The plan must answer within 5 days.", None, "within 5 days", "duty"), ("keep a log", "Quality", None, None)]
    assert set(compliance.OPTIONAL) <= set(got[0].asDict()) and len(compliance.OPTIONAL) == 9


def test_extractor_fields(spark):
    s = spark.createDataFrame([(1, 0, "H", 1, "If asked, staff must not share data. Quiet.")], "doc_id long, section_no int, heading string, page_start int, text string")
    r = models.RuleExtractor().extract(s).first()
    assert (r.obligation_type, r.obligation_level, r.action_required, r.condition) == ("duty", "prohibited", "share data", "If asked")
