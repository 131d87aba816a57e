"""The workflow with models that are plain functions, and spreadsheets there and back."""

import json

import pytest
from pyspark.sql import functions as F

from finlattice.operators import review
from finlattice.plans import providers, tables, workflow
from finlattice.sources import documents, spreadsheets, workbook

CHART = [("5001", "Vaccine Revenue", None, 0), ("7340", "Rent", None, 1)]


def extractor(prompts, images):
    out = []
    for p in prompts:
        if "Which pages" in p:
            out.append('```json\n{"income_statement": [2, 3, 9], "cash_flow": "x"}\n```')
        elif "holds nothing" in p:
            out.append("sorry")
        else:
            rows = [{"label": x, "values": [1], "is_subtotal": False} for x in ("Revenue", "Vaccines", "Rent")]
            out.append("<think>a</think>" + json.dumps({"title": "P", "periods": ["2024"], "sections": [{"name": "ALL", "rows": rows if "Mend this: again" in p or "good" in p else []}]}))
    return out


def judger(prompts, images):
    return [json.dumps({"scores": {"a": 9 if "Rent" in p else 1}, "passed": "Rent" in p, "feedback": "again"}) for p in prompts]


def books(prompts, images):
    sure = "low" if "look again" not in prompts[0] else "high"
    return [json.dumps([{"label": "Rent", "account_id": "7340", "account_name": "Rent", "confidence": sure}, {"label": "Vaccines", "account_id": "5001", "confidence": "high"}])]


def strict(prompts, images):
    return [json.dumps({"passed": '"review_rate":0.0' in p, "scores": {}}) for p in prompts]


def test_flow(spark):
    pages = spark.createDataFrame([("d", 1, "x" * 200), ("d", 2, "good page"), ("d", 3, "holds nothing"), ("e", 1, "y" * 200), ("e", 2, "poor page"), ("e", 3, "holds nothing"), ("f", 1, "")], "doc_id string, page_num int, text string")
    found = workflow.detect(pages, extractor)
    assert {tuple(r) for r in found.collect()} == {(d, "income_statement", i, i + 2) for d in "de" for i in (0, 1)}
    s, v = workflow.extract_and_judge(pages, found, extractor, judger)
    assert {(r.doc_id, r.passed, r.attempt) for r in v.collect()} == {("d", True, 1), ("e", True, 2)}
    assert {r.doc_id: len(r.sections[0].rows) for r in s.collect()} == {"d": 3, "e": 3}
    assert {tuple(r) for r in workflow.outcome(pages, found, s).collect()} == {("d", "processed", None, None), ("e", "processed", None, None), ("f", "failed", "No statement pages found", "No data to save")}
    chart = spark.createDataFrame(CHART, "code string, name string, description string, pos int")
    rows, passed = workflow.categorise(s, chart, books, strict)
    assert {(r.label, r.coa_code, r.match_type) for r in rows.collect()} == {("Revenue", None, "section_header"), ("Vaccines", "5001", "llm"), ("Rent", "7340", "llm_retry")}
    assert {(r.doc_id, r.passed) for r in passed.collect()} == {("d", True), ("e", True)}
    rules = spark.createDataFrame([("rent", "7340", "7000", "s", "n", 2, 1)], "label string, wrong_code string, correct_code string, section string, correct_name string, count int, seq int")
    judged = workflow.judge_categories(rows, strict, rules).collect()
    assert [(r.passed, r.hard_fail) for r in judged] == [(False, True)] * 2
    unread = workflow.judge_categories(rows, lambda p, i: ["no JSON"] * len(p)).collect()
    assert all(r.passed for r in unread)


def test_images_and_types(spark):
    pages = spark.createDataFrame([("d", 1, "", b"a"), ("d", 2, None, b"b")], "doc_id string, page_num int, text string, image binary")
    ask = lambda ps, im: [json.dumps({"cash_flow": bytes(i) == b"b"}) for i in im]
    assert [tuple(r) for r in workflow.detect(pages, ask).collect()] == [("d", "cash_flow", 0, 2)]
    assert workflow.statement_types(" Cash_Flow, x,cash_flow") == ["cash_flow"] * 2 and workflow.statement_types("x") == workflow.TYPES == workflow.statement_types("all")
    s = spark.createDataFrame([("d", "cash_flow", "t", ["a"], [("n", [("x", ["1", None], False)])]), ("e", "cash_flow", "t", ["a"], [("n", [("x", ["1"], False)])])], f"doc_id string, statement_type string, {workflow.STATEMENT}")
    assert {(r.doc_id, r.passed, r.scores["completeness"]) for r in workflow.judge(s).collect()} == {("d", False, 5.0), ("e", True, 10.0)}


def test_provider_failures(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(4)], "i int, prompt string").coalesce(1)

    def ask(prompts, images):
        if "p0" in prompts:
            raise RuntimeError("down")
        return [p.upper() for p in prompts]

    got = {r.i: (r.answer, r.error) for r in providers.answers(df, ask, batch=2).collect()}
    assert got == {0: (None, "RuntimeError: down"), 1: (None, "RuntimeError: down"), 2: ("P2", None), 3: ("P3", None)}
    assert providers.call_log(providers.answers(df, ask, batch=2), "n").where("success").count() == 2
    assert tables.kept(df, "t").count() == 4


def test_documents(spark):
    files = spark.createDataFrame([("a", b"x|y|"), ("b", b"")], "path string, content binary")
    assert sorted(tuple(r) for r in documents.page_texts(files, lambda c: bytes(c).decode().split("|")).collect()) == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, ""), ("b", 1, "")]
    asked = files.withColumn("page_num", F.lit(1))
    part = lambda c, page, dpi: bytes([bytes(c)[0]])
    assert {r.path: r.image for r in documents.page_images(asked, part, strict=False).collect()} == {"a": b"x", "b": None}
    with pytest.raises(Exception, match="IndexError"):
        documents.page_images(asked, part).collect()


def test_workbook(spark, tmp_path):
    s = spark.createDataFrame([("d", "T & <x>", ["a"], [("S", [("l", ["1"], False)])])], "doc_id string, title string, periods array<string>, sections " + workflow.SECTIONS)
    cells = review.sheet(s).withColumns({"name": F.lit("d.xlsx"), "sheet": F.lit("Cash/flow")})
    spreadsheets.save(workbook.files(cells), str(tmp_path))
    [path] = tmp_path.glob("*")
    back = {tuple(r)[1:] for r in spreadsheets.cells(spark, str(tmp_path)).collect()}
    assert back == {("Cash_flow", 1, 1, "T & <x>"), ("Cash_flow", 2, 1, "Line Item"), ("Cash_flow", 2, 2, "a"), ("Cash_flow", 3, 1, "S"), ("Cash_flow", 4, 1, "l"), ("Cash_flow", 4, 2, "1")}
    wide = spark.createDataFrame([("revenue", 1.0, None), ("assets", 2.0, 3.0)], "Metric string, `A.B` double, C double")
    got = {(r.row_no, r.col_no): r.value for r in workbook.comparison_cells(wide, "Comparison", "Metric").collect()}
    assert got[1, 2] == "A.B" and got[2, 1] == "assets" and got[3, 3] is None
    assert workbook.column_name(28) == "AB" and workbook.column_number("AB12") == 28


def test_chat_endpoint(spark):
    import http.server
    import threading

    class Echo(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            [m] = said["messages"]
            self.send_response(500 if m["content"] == "bad" else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"message": {"content": f"{said['model']} {m['content']} {m.get('images')}"}}).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Echo)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = providers.ChatEndpoint(f"http://127.0.0.1:{server.server_port}/chat", "m")
    df = spark.createDataFrame([(1, "a", None), (2, "b", b"x"), (3, "bad", None)], "i int, prompt string, image binary").coalesce(1)
    got = {r.i: (r.answer, r.error) for r in providers.answers(df, ask, batch=1).collect()}
    server.shutdown()
    assert got[1] == ("m a None", None) and got[2] == ("m b ['eA==']", None) and got[3][0] is None and "500" in got[3][1]
