"""What a review of round 3 found, a test for each fault."""

from pyspark.sql import functions as F

from finlattice.operators import statements, telemetry, validation
from finlattice.plans import comparison, workflow
from finlattice.sources import files


def test_output_types_keep_equal_names_apart(spark):
    rows = [("a_cash_flow.XLSX", 1), ("a_cash_flow.XLSX", 2), ("b.json", 3)]
    got = telemetry.output_types(spark.createDataFrame(rows, "name string, key int"), workflow.TYPES)
    assert sorted((r["key"], r.statement_type, r.kind) for r in got.collect()) == [(1, "cash_flow", "xlsx"), (2, "cash_flow", "xlsx")]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_folder_of_files_is_one_report(spark, tmp_path):
    for n in ("acme.pdf", "beta.pdf/part-0.pdf", "beta.pdf/part-1.pdf", "beta.pdf/deep/x.pdf", "acme_cash_flow.pdf/part-0.pdf", "notes.txt/part-0.pdf"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"xy")
    got = files.reports(spark, str(tmp_path), whole=True)
    assert sorted((r.stem, r.length, r.path.removeprefix(f"file:{tmp_path}")) for r in got.collect()) == [("acme", 2, "/acme.pdf"), ("beta", 6, "/beta.pdf")]
    assert files.listed(spark, str(tmp_path), "b*", whole=True).where(F.col("stem") == "beta").count() == 1


def test_run_tracking_calls_for_state_by_bucket(monkeypatch):
    """A bucket of many runs reads and writes its state once a batch; open runs stay when others are due."""
    import pandas as pd

    from finlattice.streaming import runs

    calls = []

    class State:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        def __init__(self):
            self.timers = set()

        def getValueState(self, *_):
            self.state = State()
            return self.state

        def registerTimer(self, ms):
            calls.append("timer")
            self.timers.add(ms)

        def deleteTimer(self, ms):
            self.timers.remove(ms)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    names = [f.split()[0] for f in runs.EVENT.split(", ")]
    f = pd.DataFrame([{"run_id": f"r{i}", "event": runs.STARTED, "event_id": f"e{i}", "timestamp": pd.Timestamp(1_000_000 + i, unit="ms")} for i in range(500)], columns=["bucket", *names])
    handle, tracker = Handle(), runs.RunTracker(60_000, 1_000)
    tracker.init(handle)
    assert list(tracker.handleInputRows((0,), iter([f[:300], f[300:]]), None)) == [] and len(calls) == 3
    assert handle.timers == {1_001_000}
    handle.timers.clear()
    got = list(tracker.handleExpiredTimer((0,), At(1_001_099), At(1_001_000)))
    assert sorted(got[0]["run_id"]) == sorted(f"r{i}" for i in range(100)) and handle.timers == {1_001_100}


def test_many_small_spreadsheets_are_read_by_few_tasks(spark, tmp_path):
    from finlattice.sources import spreadsheets, workbook

    names = [f"c{i}" for i in range(150)]
    cells = spark.createDataFrame([(f"{n}.xlsx", s, r, c, f"{n}-{s}-{r}-{c}", "plain") for n in names for s in ("A", "B") for r in (1, 2) for c in (1, 2)], "name string, sheet string, row_no int, col_no int, value string, style string")
    spreadsheets.save(workbook.files(cells), f"{tmp_path}/out")
    back = spreadsheets.cells(spark, f"{tmp_path}/out")
    assert back.rdd.getNumPartitions() == 1
    want = {(f"{tmp_path}/out/{r['name']}", r.sheet, r.row_no, r.col_no, r.value) for r in cells.collect()}
    assert sorted(map(tuple, back.collect())) == sorted(want)
    assert {tuple(r) for r in back.where("sheet = 'B' and row_no > 1 and col_no = 2").collect()} == {w for w in want if w[1:4] == ("B", 2, 2)}


def test_spreadsheets_are_made_many_by_a_call(spark):
    from finlattice.sources import workbook

    cells = spark.createDataFrame([("b", "S", 2, 1, "x", None), ("a", "T", 1, 2, "<y>", "title"), ("a", "S", 1, 1, None, "plain"), (None, "S", 1, 1, "z", "plain")], "name string, sheet string, row_no int, col_no int, value string, style string")
    made = workbook.files(cells)
    assert "FlatMapGroups" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = workbook.cells_in(made).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("b", "S", 2, 1, "x"), ("a", "T", 1, 2, "<y>"), (None, "S", 1, 1, "z")], key=str)


def test_answers_of_a_batch_come_in_one_frame(spark, monkeypatch):
    import pandas as pd

    from finlattice.plans import providers

    frames = []
    whole = pd.DataFrame({"doc_id": range(50), "prompt": [str(i) for i in range(50)]})

    class Requests:
        columns, schema = ["doc_id", "prompt"], None

        def select(self, *_):
            from pyspark.sql.types import StructType

            self.schema = StructType()
            return self

        def where(self, _):
            return self

        def mapInPandas(self, run, schema):
            return list(run(iter([whole])))

    def ask(prompts, images):
        frames.append(len(prompts))
        if "7" in prompts:
            raise ValueError("no")
        return [p * 2 for p in prompts]

    (got,) = providers.answers(Requests(), ask, batch=4)
    assert max(frames) == 4 and list(got["doc_id"]) == list(range(50))
    assert [a for i, a in enumerate(got["answer"]) if i not in range(4, 8)] == [str(i) * 2 for i in range(50) if i not in range(4, 8)]
    assert list(got["answer"][4:8]) == [None] * 4 and list(got["error"][4:8]) == ["ValueError: no"] * 4 and got["error"][8] is None


def test_a_stream_takes_small_documents_by_bytes(spark, tmp_path):
    from finlattice.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    for i in range(7):
        (tmp_path / "in" / f"r{i}.pdf").write_bytes(b"x" * 10)
    seen = []
    ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", lambda docs, ledger, batch: seen.append(docs.count()), files_per_trigger=2, bytes_per_trigger=1 << 20).awaitTermination()
    assert seen == [7]


def only_dealt(df, key):
    """Rows go by `key` once, ahead of any sort, to as many tasks as a shuffle has; adaptive execution merges none."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    at = plan.index("Exchange")
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return plan.count("Exchange") == 1 and f"Exchange hashpartitioning({key}#" in plan and f", {n}), REPARTITION_BY_NUM" in plan and "Sort" in plan[:at] and "Sort" not in plan[at:] and "Aggregate" not in plan[at:]


def test_no_task_sorts_the_cells_of_a_whole_split(spark):
    """Memory of a task: companies' cells are dealt out before they are sorted (F12, F13)."""
    rows = [(i, kind, 0, at, label, str(i * f)) for i in range(1, 40) for at, (kind, label, f) in enumerate([("income_statement", "Total revenue", 8), ("income_statement", "Net income", 2), ("balance_sheet", "Total assets", 7), ("income_statement", "Revenue", 1)])]
    cells = spark.createDataFrame(rows, "company long, statement_type string, section_pos int, row_pos int, label string, value_raw string")
    metrics, wide = statements.company_metrics(cells), comparison.compared(cells)
    assert only_dealt(metrics, "company") and only_dealt(wide, "company")
    assert {(r.company, r.metric): r.value for r in metrics.collect()} == {(i, m): float(i * f) for i in range(1, 40) for m, f in (("revenue", 8), ("net_income", 2), ("total_assets", 7))}
    assert {(r.company, r.revenue, r.net_margin, r.return_on_assets, r.total_debt) for r in wide.collect()} == {(i, i * 8.0, 25.0, 28.6, None) for i in range(1, 40)}


def test_a_cell_speaks_once_for_a_metric():
    """Of a metric's aliases in one label the first counts; others only made more rows (F12, F13)."""
    import pandas as pd

    from finlattice.functions import aliases

    hits = aliases._metrics(pd.Series(["total revenue", "net sales", None]))
    assert [[(h["metric"], h["alias_pos"]) for h in x] for x in hits] == [[("revenue", 0)], [("revenue", 3)], []]


def balance_cells(spark):
    rows = [(d, "balance_sheet", s, at, d % 5, "Total", True, p, float(v * d - 30 * p)) for d in range(1, 30) for at, (s, v) in enumerate([("Assets", 4), ("assets", 9), ("Liabilities", 5), ("Equity", 4), ("Notes", 100)]) for p in (0, 1)]
    return spark.createDataFrame(rows, "doc_id long, statement_type string, section_name string, section_pos int, row_pos int, label string, is_subtotal boolean, period_pos int, value_num double")


def test_totals_are_dealt_out_once(spark):
    """Memory of a task: a document's totals stay where they were dealt to, through all four steps (F16)."""
    totals = validation.role_totals(balance_cells(spark))
    assert only_dealt(totals, "doc_id")
    assert {(r.doc_id, r.period_pos): (r.assets, r.liabilities, r.equity) for r in totals.collect()} == {(d, p): (9.0 * d - 30 * p, 5.0 * d - 30 * p, 4.0 * d - 30 * p) for d in range(1, 30) for p in (0, 1)}


def test_last_values_are_dealt_out_once(spark):
    """Memory of a task: the other checks of findings() sort no whole split either (F15)."""
    cells = balance_cells(spark)
    last = validation._last_values(cells, F.when(F.col("section_name") != "Notes", F.lower("section_name")))
    assert only_dealt(last, "doc_id")
    assert {(r.doc_id, r.metric): r.v for r in last.where("period_pos = 0").collect()} == {(d, m): float(v * d) for d in range(1, 30) for m, v in (("assets", 9), ("liabilities", 5), ("equity", 4))}
    assert validation.findings(cells).where("check = 'negative_asset'").count() == sum(v * d < 30 for d in range(1, 30) for v in (4, 9))
