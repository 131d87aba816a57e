"""The command line over a folder of stand-in reports, and the comparison of files."""

import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from finlattice.__main__ import learned_rules, main
from finlattice.operators import matching
from finlattice.plans import comparison
from finlattice.sources import files, spreadsheets

#: Where a model in a worker writes what it is asked.
NOTED = Path(tempfile.gettempdir()) / "finlattice-test-noted.txt"


def read(content):
    return bytes(content).decode().split("|")


def noted(prompts, images):
    """answer(), which writes down what it is asked."""
    with open(NOTED, "a") as f:
        f.writelines(p + "\n" for p in prompts)
    return answer(prompts, images)


def answer(prompts, images):
    out = []
    for p in prompts:
        if "Which pages" in p:
            out.append('{"income_statement": [1], "cash_flow": [2]}' if "Sales" in p else "{}")
        elif "Give the" in p:
            rows = [{"label": x, "values": ["10"], "is_subtotal": False} for x in ("Sales", "Rent")]
            out.append(json.dumps({"title": "P", "periods": ["2024"], "sections": [{"name": "ALL", "rows": rows}]}))
        elif "account" in p:
            out.append(json.dumps([{"label": "Rent", "account_id": "7340", "account_name": "Rent", "confidence": "high"}]))
        else:
            out.append(json.dumps({"scores": {"a": 9}, "passed": True}))
    return out


def test_command_line(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "acme.pdf").write_bytes(("Sales " * 30 + "|cash").encode())
    chart = tmp_path / "chart.json"
    chart.write_text(json.dumps([{"code": "7340", "name": "Rent"}]))
    args = ["--folder", str(folder), "--out", str(out), "--reader", "test_command:read", "--model", "test_command:answer", "--chart", str(chart)]
    assert main(args, spark) == 0
    names = {p.name.rsplit("_", 2)[0] for p in out.glob("*.xlsx")}
    assert names == {"acme_income_statement", "acme_cash_flow"}
    saved = spark.read.json(f"{out}/json").select("doc_id", "statement_type").collect()
    assert [tuple(r) for r in saved] == [("acme", "cash_flow")]
    assert "7340" in "".join(p.read_text() for p in (out / "json-categorised").rglob("*.json"))
    (folder / "empty.pdf").write_bytes(b"nothing")
    assert main([*args, "--no-categorization"], spark) == 1
    assert main(["--folder", str(tmp_path / "in"), "--reader", "test_command:read"], spark) == 1
    (tmp_path / "x.tmp").write_text("")
    assert main(["--clean", "--tmp", str(tmp_path)], spark) == 0 and not (tmp_path / "x.tmp").exists()


def test_command_line_logs_caches_and_learned_rules(spark, tmp_path):
    folder, out, memory = tmp_path / "in", tmp_path / "out", tmp_path / "memory"
    folder.mkdir()
    memory.mkdir()
    (folder / "acme.pdf").write_bytes(("Sales " * 30 + "|cash").encode())
    head = "| Label | Section | Wrong | Correct | Name | Count |\n|---|---|---|---|---|---|\n"
    (memory / "_default.md").write_text(head + "| Rent | ALL | 1 | 2 | Two | 1 |\n| Fuel | ALL | 5 | 6 | Six | 1 |\n")
    (memory / "acme.md").write_text(head + "| rent | all | 7340 | 7000 | Seven | 3 |\n")
    chart = tmp_path / "chart.json"
    chart.write_text(json.dumps([{"code": "7340", "name": "Rent"}]))
    args = ["--folder", str(folder), "--out", str(out), "--reader", "test_command:read", "--model", "test_command:noted", "--chart", str(chart), "--memory", str(memory), "--practice", "acme", "--cache", f"{tmp_path}/cache", "--pace", "1000"]
    NOTED.write_text("")
    assert main(args, spark) == 0
    run = spark.read.json(f"{out}/metrics").collect()
    assert [(r.pdf_file, r.status, r.success) for r in run] == [("acme", "completed", True)] and run[0].llm_calls >= 4
    logged = {r.event: r.n for r in spark.read.json(f"{out}/logs").groupBy("event").agg(F.count("*").alias("n")).collect()}
    assert logged["run_started"] == logged["run_completed"] == 1 and logged["llm_call"] == run[0].llm_calls
    got = {r.label: (r.wrong_code, r.correct_code) for r in learned_rules(spark, str(memory), "acme").collect()}
    assert got == {"rent": ("7340", "7000"), "Fuel": ("5", "6")}
    prompts = NOTED.read_text()
    assert "7000 Seven (NEVER 7340)" in prompts and "6 Six (previously" in prompts
    n = len(prompts)
    assert main(args, spark) == 0 and len(NOTED.read_text()) == n  # every answer was known


def test_command_line_as_a_stream(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    args = ["--stream", "--folder", str(folder), "--out", str(out), "--reader", "test_command:read", "--model", "test_command:answer", "--statements", "income_statement"]
    (folder / "acme.pdf").write_bytes(("Sales " * 30).encode())
    assert main(args, spark) == 0 and main(args, spark) == 0
    (folder / "beta.pdf").write_bytes(("Sales " * 31).encode())
    (folder / "gamma.pdf").write_bytes(b"nothing")
    assert main(args, spark) == 1
    names = sorted(p.name.rsplit("_", 2)[0] for p in out.glob("*.xlsx"))
    assert names == ["acme_income_statement", "beta_income_statement"]
    assert sorted(r.doc_id for r in spark.read.json(f"{out}/json").collect()) == ["acme", "beta"]
    assert sorted((r.pdf_file, r.success) for r in spark.read.json(f"{out}/metrics").collect()) == [("acme", True), ("beta", True), ("gamma", False)]


def test_comparison_of_files(spark, tmp_path):
    for c, n in (("a", 100), ("b", 50)):
        rows = [{"label": "Total revenue", "values": [str(n)]}, {"label": "Gross profit", "values": [f"({n // 2})"]}]
        (tmp_path / f"{c}.json").write_text(json.dumps({"title": c, "statement_type": "income_statement", "periods": ["2024"], "sections": [{"name": "S", "rows": rows}]}))
    out = comparison.compare_files(spark, {c: f"{tmp_path}/{c}.json" for c in "ab"}, str(tmp_path / "out"))
    assert {r.company: (r.revenue, r.gross_profit, r.gross_margin) for r in out.collect()} == {"a": (100.0, -50.0, -50.0), "b": (50.0, -25.0, -50.0)}
    cells = {(r.row_no, r.col_no): r.value for r in spreadsheets.cells(spark, str(tmp_path / "out")).collect()}
    assert [cells[1, i] for i in (1, 2, 3)] == ["Metric", "a", "b"]
    assert spark.read.json(f"{tmp_path}/out/peer_comparison").count() == 2


def test_dropped_reports_stream(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    stream = files.report_stream(spark, str(tmp_path)).select("path", "length")
    q = stream.writeStream.format("memory").queryName("dropped").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    assert spark.table("dropped").count() == 1


def test_balance_accounts_are_a_choice(spark):
    chart = spark.createDataFrame([("1100", "Inventory", 0), ("7100", "Inventory Loss", 1)], "code string, name string, pos int")
    label = spark.createDataFrame([("Inventory",)], "label string")
    assert matching.match(label, chart).first()["code"] == "1100" and matching.match(label, chart, allow_balance_sheet=False).first()["code"] == "7100"


def test_poppler_tools(tmp_path, monkeypatch):
    from finlattice.sources import poppler

    for name, body in (("pdftotext", 'cat; printf "\\fpage two\\f"'), ("pdftoppm", 'printf "%s " "$@"; cat'), ("pdfinfo", 'echo "Pages:  3"; cat >/dev/null')):
        (tmp_path / name).write_text(f"#!/bin/sh\n{body}\n")
        (tmp_path / name).chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    assert poppler.texts(b"one") == ["one", "page two"]
    assert poppler.image(b"x", 2, 72) == b"-png -r 72 -f 2 -l 2 - x"
    assert poppler.info(b"x") == "Pages:  3\n"
    (tmp_path / "pdfinfo").write_text("#!/bin/sh\necho broken >&2\nexit 1\n")
    try:
        poppler.info(b"x")
    except ValueError as e:
        assert str(e) == "pdfinfo: broken"
    else:
        raise AssertionError


def test_documents_are_listed_by_tasks_and_settle_once(spark, tmp_path):
    from finlattice.sources import spreadsheets
    from finlattice.streaming import ingest

    folder, out, seen = tmp_path / "in", tmp_path / "out", []
    docs = spark.range(25).select(F.concat(F.lit("d"), "id", F.lit(".pdf")).alias("name"), F.encode(F.concat(F.lit("text "), "id"), "UTF-8").alias("content"))
    spreadsheets.save(docs, str(folder), per_folder=4)
    (folder / "flat.pdf").write_bytes(b"flat")
    (folder / "other.txt").write_bytes(b"no report")
    (folder / "_hidden.pdf").write_bytes(b"no report")

    def process(d, ledger, batch):
        seen.append(sorted((r.doc_id, bytes(r.content).decode(), r.path) for r in d.collect()))

    def call(**options):
        seen.clear()
        ingest.ingest(spark, str(folder), str(out), process, **options).awaitTermination()
        return sorted(r[:2] for batch in seen for r in batch)

    assert call(files_per_trigger=10) == sorted([("flat", "flat"), *((f"d{i}", f"text {i}") for i in range(25))])
    assert len(seen) >= 3 and max(map(len, seen)) <= 10
    paths = {r[2] for batch in seen for r in batch}
    assert paths == {r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(str(folder)).select("path").collect()}
    assert ".pdf" not in "".join(p.read_text() for p in (out / "_checkpoint").rglob("*") if p.is_file() and not p.name.endswith(".crc"))
    assert call() == [] and seen == []
    (folder / "flat.pdf").write_bytes(b"flat again")
    (folder / "new.pdf").write_bytes(b"new")
    assert call(bytes_per_trigger=1 << 20) == [("flat", "flat again"), ("new", "new")] and len(seen) == 1
    assert ingest.settled(spark, str(out)).count() == 28


def test_an_output_begun_by_the_file_stream_goes_on(spark, tmp_path):
    from finlattice.streaming import ingest

    folder, out, seen = tmp_path / "in", tmp_path / "out", []
    folder.mkdir()
    process = lambda d, ledger, batch: seen.extend(r.doc_id for r in d.collect())
    (folder / "a.pdf").write_bytes(b"x")
    files.report_stream(spark, str(folder)).writeStream.foreachBatch(ingest.batch_of(process, str(out))).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start().awaitTermination()
    (folder / "b.pdf").write_bytes(b"x")
    for _ in range(2):
        ingest.ingest(spark, str(folder), str(out), process).awaitTermination()
    assert seen == ["a", "b"]
