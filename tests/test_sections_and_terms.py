import re

from pyspark.sql import functions as F

from auditloom.functions import text as X
from auditloom.operators import headers, lines, lists, pack, review, terms, xref
from auditloom.plans import compliance
from auditloom.sources import shared


def marked(spark, *texts):
    return lines.to_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def sections(spark, text):
    return [r.asDict() for r in lines.merge_empty(lines.segment(marked(spark, text))).orderBy("section_no").collect()]


def chunks(spark, pages, size, overlap=0, name="f/a.pdf"):
    rows = spark.createDataFrame([(name, n, t) for n, t in pages], "source_file string, page_number int, text string")
    return [(r.chunk_index, r.page_number, r.text) for r in pack.chunk(pack.gather_pages(rows), size, overlap).orderBy("chunk_index").collect()]


def brute_pack(pages, size, overlap):
    """The packing rules, step by step."""
    out, tail = [], ""
    buf, n, start = [], 0, 1

    def emit(sep, page):
        nonlocal buf, n, tail
        body = sep.join(buf)
        text = (f"{tail}\n\n{body}" if tail else body).strip()
        if buf and text:
            out.append((len(out), page, text))
            tail = text[-overlap:] if overlap else ""
        buf, n = [], 0

    for page, p in [(g, p.strip()) for g, t in pages for p in t.split("\n\n") if p.strip()]:
        if len(p) > size:
            emit("\n\n", start)
            start = page
            for s in [s for s in p.replace(". ", ".\x00").split("\x00") if s]:
                if n + bool(buf) + len(s) > size:
                    emit(" ", start)
                n += bool(buf) + len(s)
                buf.append(s)
            emit("\n\n", start)
            continue
        if n + (2 if buf else 0) + len(p) > size:
            emit("\n\n", start)
        if not buf:
            start = page
        n += (2 if buf else 0) + len(p)
        buf.append(p)
    emit("\n\n", start)
    return out


def test_packing(spark):
    assert chunks(spark, [(1, "One.\n\nTwo.")], 100) == [(0, 1, "One.\n\nTwo.")]
    assert chunks(spark, [(1, "  \n\n ")], 100) == []
    assert chunks(spark, [(1, "aaaa\n\nbbbb"), (2, "cccc")], 6) == [(0, 1, "aaaa"), (1, 1, "bbbb"), (2, 2, "cccc")]
    assert chunks(spark, [(1, "aaaa\n\nbbbb")], 6, 2) == [(0, 1, "aaaa"), (1, 1, "aa\n\nbbbb")]
    pages = [(1, "Short one.\n\n" + "This is a sentence. " * 9 + "end."), (2, "x" * 70 + "\n\nTail part. " + "y" * 55), (4, "z")]
    for size in (20, 50, 64, 200):
        for overlap in (0, 7):
            assert chunks(spark, pages, size, overlap) == brute_pack(pages, size, overlap)
    every = chunks(spark, pages, 60)
    assert "".join("".join(t.split()) for _, _, t in every) == "".join("".join(t.split()) for _, t in pages)


def test_folder_and_sentences(spark):
    row = spark.range(1).select(X.folder_of(F.lit("a/b.pdf")).alias("a"), X.folder_of(F.lit("b.pdf")).alias("b"), X.sentences(F.lit(" One. Two!  Three? e.g.four ")).alias("s")).first()
    assert (row.a, row.b, row.s) == ("a", "", ["One.", "Two!", "Three?", "e.g.four"])
    got = spark.range(1).select(X.sentences(F.lit("One.\xa0Two.\u2003 Three\xa0")).alias("s"), X.signature(F.lit("\xa0Page\u2009 7\xa0")).alias("g"), X.paragraphs(F.lit("\xa0\n\na\xa0")).alias("p"), X.normal_key(F.lit("\xa0A\xa0 b.")).alias("k"), X.blank(F.lit("\xa0\u3000\x1f")).alias("b")).first()
    assert tuple(got) == (["One.", "Two.", "Three"], "page #", ["a"], "a b", True)


def test_segmentation(spark):
    assert [(s["heading"], s["text"], s["level"]) for s in sections(spark, "")] == [("Preamble", "", 1)]
    got = sections(spark, "intro\n[PAGE 2]\n[HEADING 1] A\nbody a\n[TABLE]\n| x | y |\n| 1 | 2 |\n[/TABLE]\n[PAGE 3]\n[HEADING 2] B\n\n[HEADING 3] C\nbody c\nmore\n")
    assert [(s["section_no"], s["heading"], s["level"], s["text"], s["tables"], s["page_start"], s["page_end"]) for s in got] == [
        (0, "Preamble", 1, "intro", [], 1, 2), (1, "A", 1, "body a", ["| x | y |\n| 1 | 2 |"], 2, 3), (2, "C", 3, "body c\nmore", [], 3, 3)]
    # a section with a table alone is not empty; of empty ones in a row the last gives its page
    got = sections(spark, "[HEADING 1] A\n[TABLE]\none\n[/TABLE]\n[PAGE 2]\n[HEADING 1] B\n[PAGE 3]\n[HEADING 1] B2\n[PAGE 4]\n[HEADING 1] C\ntext\n[HEADING 1] D")
    assert [(s["section_no"], s["heading"], s["tables"], s["page_start"], s["page_end"]) for s in got] == [(0, "A", ["one"], 1, 2), (1, "C", [], 3, 4), (2, "D", [], 4, 4)]
    # marks are whole lines, and a heading has a text
    got = sections(spark, "[PAGE 2] trailing words\n[HEADING 2] \n[HEADING 2]none\n [PAGE 7]\n[HEADING 3]  Named \nx\r\n[PAGE 5]\u2028y")
    assert [(s["heading"], s["level"], s["text"], s["page_start"], s["page_end"]) for s in got] == [
        ("Preamble", 1, "[PAGE 2] trailing words\n[HEADING 2] \n[HEADING 2]none\n [PAGE 7]", 1, 1), ("Named", 3, "x\ny", 1, 5)]
    # an open table keeps its lines out, an end without a start is an empty table
    got = sections(spark, "[HEADING 1] A\nx\n[/TABLE]\n[HEADING 1] B\ny\n[TABLE]\nlost")
    assert [(s["heading"], s["text"], s["tables"]) for s in got] == [("A", "x", [""]), ("B", "y", [])]


def test_sub_split(spark):
    paras = ["p%d " % i + "w" * 40 for i in range(6)]
    s = lines.merge_empty(lines.segment(marked(spark, "[HEADING 2] Long\n" + "\n\n".join(paras))))
    got = lines.sub_split(s, 100).orderBy("piece_no").collect()
    assert [r.heading for r in got] == ["Long"] + ["Long (cont.)"] * 2 and "\n\n".join(r.text for r in got) == "\n\n".join(paras)
    assert all(r.char_count == len(r.text) <= 100 for r in got)


def test_batches(spark):
    rows = [(1, i, n, []) for i, n in enumerate((5, 5, 900, 5, 5, 5, 7))] + [(1, 9, 3, ["t"])]
    s = spark.createDataFrame(rows, "doc_id long, section_no int, char_count int, tables array<string>")
    got = {r.section_no: r.batch_no for r in lines.batch_small(s, 10, 3).collect()}
    assert got == {0: 0, 1: 0, 3: 0, 4: 1, 5: 1, 6: 1}
    assert lines.split_large(s, 0, 3).where("NOT large").count() == 0


def test_obligations(spark):
    yes = ["The plan MUST act", "reply within 5 business days", "acts may not stop", "pursuant to law", "develop it"]
    no = ["mustard", "The plan acts", "within five days", "shallow"]
    got = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", X.has_obligation(F.col("t")).alias("k")).collect()
    assert {r.t for r in got if r.k} == set(yes)


def test_signatures_and_buckets(spark):
    cases = {"  Page 3 of 17 ": "page # of #", "12 | 13 - /": "", "3.14": "", "A\t B": "a b", "": ""}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.signature(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == cases
    ys = [0.0, 0.0125, 0.0375, 0.5, 0.9874, 0.03]
    got = spark.createDataFrame([(y,) for y in ys], "y double").select("y", X.y_bucket(F.col("y")).alias("b")).collect()
    assert [r.b for r in got] == [round(round(y / 0.025) * 0.025, 4) for y in ys]


def test_headers(spark):
    rows = [(1, p, k, 0, 0.0, y, 9.0, y + 10, 800.0, 10.0, t) for p in range(1, 5) for k, (y, t) in enumerate([(30.0, f"Manual {p}"), (120.0, f"Body {p * p}"), (780.0, "foot"), (400.0, "Manual 9" if p == 2 else f"b{'x' * p}")])]
    b = spark.createDataFrame(rows, "doc_id long, page_number int, src_no int, type int, x0 double, y0 double, x1 double, y1 double, page_height double, size double, text string")
    left = {(r.page_number, r.text) for r in headers.drop_headers(b).collect()}
    assert left == {(p, f"Body {p * p}") for p in range(1, 5)} | {(p, f"b{'x' * p}") for p in (1, 3, 4)}
    one = b.where("page_number = 1")
    assert headers.drop_headers(one).count() == 4


def test_lists(spark):
    text = "1. one\n   a. sub\n   more sub\n\n      i. deep\n   b) sub two\n2. two"
    got = [(r.path, r.marker, r.text, r.level, r.parent_no) for r in lists.parse(marked(spark, text)).orderBy("node_no").collect()]
    assert got == [("1", "1.", "one", 1, None), ("1.a", "a.", "sub more sub", 2, 1), ("1.a.i", "i.", "deep", 3, 2), ("1.b", "b)", "sub two", 2, 1), ("2", "2.", "two", 1, None)]
    flat = "1. A\n(a) B\n(i) C\n(ii) D\nb. E\n2. F"
    assert [r.path for r in lists.parse(marked(spark, flat)).orderBy("node_no").collect()] == ["1", "1.a", "1.a.i", "1.a.ii", "1.b", "2"]
    orphan = "      a. first\n1. second\n      b. third"
    assert [(r.path, r.parent_no, r.is_root) for r in lists.parse(marked(spark, orphan)).orderBy("node_no").collect()] == [("a", None, False), ("1", None, True), ("1.b", 2, False)]
    indents = {" \ta. x": 4, "\ta. x": 4, "   \t a. x": 5, "\t\ta. x": 8, "    \ta. x": 8, "  a. x": 2}
    got = spark.createDataFrame([(t,) for t in indents], "t string").select("t", X.list_item(F.col("t"))["indent"].alias("n")).collect()
    assert {r.t: r.n for r in got} == indents
    tree = lists.trees(lists.parse(marked(spark, text))).first().tree
    assert '"path": "1.a.i"' in tree and tree.count('"level": 1') == 2
    assert lists.parse(marked(spark, "no items\nhere")).count() == 0


def test_cross_references(spark):
    s = spark.createDataFrame([(1, 0, "See Section III.A and Appendix B, per Section 4.2. Under 42 CFR § 438.210(b) and see Section iii.a.", [], "Intro"), (1, 1, "Body of it.", [], "III.A Credentialing"), (1, 2, "", ["| t |"], "Appendix B – Definitions"), (1, 3, "see Section 4.2", [], "4.2 Own")], "doc_id long, section_no int, text string, tables array<string>, heading string")
    got = [(r.target_key, r.ref_type) for r in xref.detect(s).where("section_no = 0").orderBy("ref_no").collect()]
    assert got == [("III.A", "section"), ("4.2", "section"), ("42 CFR § 438.210(b)", "cfr"), ("B", "appendix")]
    keys = {r.key: r.heading for r in xref.index(s).collect()}
    assert keys["iii.a"] == keys["credentialing"] == "III.A Credentialing" and keys["b"] == "Appendix B – Definitions"
    resolved = [(r.section_no, r.heading, r.summary) for r in xref.resolve_sections(s).orderBy("section_no", "rank").collect()]
    assert resolved == [(0, "III.A Credentialing", "Body of it."), (0, "4.2 Own", "see Section 4.2"), (0, "Appendix B – Definitions", "| t |")]


def test_truncate_and_numbers(spark):
    text = "First sentence. Second sentence here. Third."
    got = spark.range(1).select(X.truncate(F.lit(text), 40).alias("a"), X.truncate(F.lit(text), 20).alias("b"), X.truncate(F.lit(text), 99).alias("c"), X.truncate(F.lit("x" * 30), 10).alias("d")).first()
    assert tuple(got) == ("First sentence. Second sentence here. …", "First sentence. …", text, "x" * 10 + " …")
    cases = {"III.A Credentialing": "III.A", "Section 4.2 Provider": "4.2", "Appendix b – Def": "B", "4.2 Provider": "4.2", "A. Definitions": "A", "42 CFR": None, "Quiet words": None}
    got = spark.createDataFrame([(k,) for k in cases], "h string").select("h", X.section_number(F.col("h")).alias("n")).collect()
    assert {r.h: r.n for r in got} == cases


def test_acronyms(spark):
    cases = {("Enhanced Care Management", "ECM"): True, ("Population of Focus", "POF"): True, ("Random Words", "ECM"): False, ("Care", "!!"): False}
    got = spark.createDataFrame(list(cases), "p string, a string").select("p", "a", X.initials_match(F.col("p"), F.col("a")).alias("k")).collect()
    assert {(r.p, r.a): r.k for r in got} == cases
    found = terms.inline_acronyms(marked(spark, "x\n[PAGE 3]\nThe Enhanced Care Management (ECM) plan\n[PAGE 4]\nEnhanced Care Management (ECM)")).collect()
    assert [(r.abbreviation, r.page) for r in found] == [("ECM", 3)]
    found = terms.inline_acronyms(marked(spark, "Managed Care Plan\n\n (MCP) x\n[PAGE 2]\nOf the Population of\nFocus (POF) and Enhanced Care Management\n(ECM) y [PAGE 6] Whole Person Care\xa0(WPC)")).orderBy("abbreviation").collect()
    assert [(r.term, r.abbreviation, r.page) for r in found] == [("Enhanced Care Management", "ECM", 2), ("Managed Care Plan", "MCP", 1), ("Whole Person Care", "WPC", 6)]


def test_term_precedence(spark):
    text = "[HEADING 1] Glossary\nEnhanced Care Management: Whole person care for members.\n[HEADING 1] Other\nEnhanced Care Management (ECM) and Managed Care Plan (MCP).\n[TABLE]\n| Term | Definition |\n| managed care plan | A plan of managed care |\n| Outreach | Contact with a member |\n[/TABLE]"
    m = marked(spark, text)
    got = {(r.source, r.term) for r in terms.all_terms(m, lines.merge_empty(lines.segment(m))).collect()}
    assert got == {("glossary", "Enhanced Care Management"), ("inline_acronym", "Managed Care Plan"), ("definition_table", "Outreach")}


def test_hierarchy(spark):
    req = spark.createDataFrame([(1, 0, "S3"), (1, 1, "S1"), (1, 2, "S3"), (1, 3, None), (1, 4, "S3")], "doc_id long, seq long, section_heading string")
    sec = spark.createDataFrame([(1, 0, "S1", 1), (1, 1, "S3", 2), (1, 2, "S3", 3)], "doc_id long, section_no int, heading string, level int")
    assert [(r.id, r.parent_id) for r in review.hierarchy(req, sec).orderBy("id").collect()] == [(1, None), (2, None), (3, 2), (4, None), (5, 4)]


def test_extraction_end_to_end(spark):
    text = "[PAGE 1]\n[HEADING 1] Duties\nThe plan must report. The sky is blue. Staff shall keep records.\n[HEADING 3] Detail\nThe plan must report.\n[TABLE]\n| Requirement | Owner |\n| keep a log | Compliance |\n[/TABLE]\n[HEADING 1] Quiet\nNothing here."
    got = compliance.extract(marked(spark, text)).orderBy("id").collect()
    assert [(r.id, r.parent_id, r.exact_quote, r.actor) for r in got] == [(1, None, "The plan must report.", None), (2, None, "Staff shall keep records.", None), (3, 2, "keep a log", "Compliance")]
    assert got[0].reference == "Duties, page 1; Detail, page 1"


def test_extraction_holds_few_documents_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(shared, "PART_BYTES", 1 << 14, raising=False)
    got = compliance.extract(marked(spark, *(f"[HEADING 1] Duties\nThe plan must report to office {i}.\nStaff shall keep records." for i in range(500))))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) < 250


def test_signature_of_all_white_space(spark):
    texts = ["".join(f"A{c}{d}9 " for d in X.SPACE[1:-1]) + "Ä  12\t　x" for c in X.SPACE[1:-1]] + [" 1 . 2 ", " # ", "", None, "Page  1 of 22"]
    got = [r.s for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(X.signature(F.col("t")).alias("s")).collect()]
    space = re.compile(f"{X.SPACE}+")
    want = [None if t is None else space.sub(" ", re.sub(r"[0-9]+", "#", t.strip(X.SPACE[1:-1]).lower())) for t in texts]
    assert got == [w if w is None or re.sub(r"[#.,|\-/\\ ]", "", w) else "" for w in want]


def test_lines_are_matched_by_their_marks_alone(spark):
    rows = spark.createDataFrame([(0, p, t) for p in range(4) for t in (f"Page {p}", f"text {'x' * p}", "12")], "doc int, page int, line string")
    marked = headers.with_marks(rows).select("doc", "page", F.length("line").alias("chars"), "mark")
    left = headers.without_repeated(marked, "doc", "page").collect()
    assert sorted((r.page, r.chars) for r in left) == sorted([(p, 5 + p) for p in range(4)] + [(p, 2) for p in range(4)])
