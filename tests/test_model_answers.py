"""Model answers in JSON: hand-made cases."""

from auditloom.functions import llmjson


def test_batch_headings(spark):
    sections = spark.createDataFrame([(0, 0, "Intake"), (0, 1, "Scope"), (0, 2, "Intake"), (0, 3, "Care Coordination")], "batch_no long, section_no int, heading string")
    heads = ["Intake", "INTAKE", " Scope ", "The Intake form", "Coordination", "", "Nothing"]
    raw = '{"sections": [' + ", ".join(f'{{"heading": "{h}", "requirements": [{{"text": "{i}"}}]}}' for i, h in enumerate(heads)) + "]}"
    got = llmjson.batch(spark.createDataFrame([(0, "So:\n" + raw)], "batch_no long, raw string"), sections).collect()
    assert {r.text: (r.section_no, r.section_heading) for r in got} == {"0": (2, "Intake"), "2": (1, "Scope"), "3": (2, "Intake"), "4": (3, "Care Coordination")}


def test_verdict_types(spark):
    items = ['{"requirement_id": 1, "needs_human_review": "false"}', '{"requirement_id": "2", "needs_human_review": true}', '{"requirement_id": 3.0, "needs_human_review": 0}', '{"requirement_id": 4, "needs_human_review": ""}', "5", '{"verified_answer": "YES", "needs_human_review": null}']
    got = llmjson.verdicts(spark.createDataFrame([("[" + ", ".join(items) + "]",)], "raw string")).orderBy("seq").collect()
    assert [(r.seq, r.requirement_id, r.needs_human_review, r.verified_answer) for r in got] == [(0, 1, True, None), (1, None, True, None), (2, 3, False, None), (3, 4, False, None), (5, None, False, "YES")]


def test_answer_fallbacks(spark):
    raws = ["no json", '{"confidence": 1}', '{"answer": "unsure"}', '{"answer": "YES", "confidence": 2}', '```json\n{"answer": "Partial", "confidence": "0.5", "page_number": "7"}\n```']
    got = llmjson.answers(spark.createDataFrame(list(enumerate(raws)), "requirement_id int, raw string")).orderBy("requirement_id").collect()
    assert [(r.answer, r.needs_human_review, r.reasoning) for r in got] == [
        ("no", True, "Parse error: not JSON"), ("no", True, "Parse error: no answer"), ("no", True, "Parse error: 'unsure' is no answer"), ("no", True, "Parse error: confidence is not between 0 and 1"), ("partial", False, "")]
    assert (got[4].confidence, got[4].page_number) == (0.5, 7)


def test_answers_of_few_batches_stay_in_place(spark):
    sections = spark.createDataFrame([(0, 0, "Intake"), (0, 1, None), (1, 0, "Scope"), (1, 1, None)], "batch_no long, section_no int, heading string")
    raw = '{"sections": [null, {"heading": null, "requirements": [{"text": "x"}]}, {"heading": "Intake", "requirements": null}, {"heading": "Intake", "requirements": [{"text": "a"}, null, {"actor": "b"}, {"text": "c"}]}]}'
    rows = spark.range(0, 4000, 1, 8).selectExpr("id % 3 AS batch_no", f"CASE WHEN id % 2 = 0 THEN '{raw}' ELSE 'none' END AS raw")
    found = llmjson.batch(rows, sections).selectExpr("*", "spark_partition_id() AS p").groupBy("batch_no", "answer_no", "item_no", "section_no", "section_heading", "text").agg({"*": "count", "p": "approx_count_distinct"}).collect()
    assert sorted(tuple(r)[:6] for r in found) == [(0, 3, 0, 0, "Intake", "a"), (0, 3, 3, 0, "Intake", "c")]
    assert all(r["count(1)"] == 667 and r["approx_count_distinct(p)"] == 8 for r in found)
