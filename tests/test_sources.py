"""Scans and sinks on small files; a stream against the same batch."""

import base64
import json

from pyspark.sql import functions as F

from finlattice.sources import files, sinks
from finlattice.streaming import events

HEAD = "# Rules\n| Label | Section | Wrong | Correct | Name | Count |\n|---|---|---|---|---|---|\n"


def test_listing(spark, tmp_path):
    for n in ("acme.pdf", "acme_balance_sheet.pdf", "beta.pdf", "notes.txt"):
        (tmp_path / n).write_bytes(b"x\x00y")
    assert {r.stem for r in files.reports(spark, str(tmp_path)).collect()} == {"acme", "beta"}
    assert [r.stem for r in files.outputs_of(spark, str(tmp_path), "acme").collect()] == ["acme_balance_sheet"]
    assert base64.b64decode(files.as_base64(spark, f"{tmp_path}/beta.pdf").first()["base64"]) == b"x\x00y"
    got = spark.createDataFrame([("Title: a\nPages:   12\n", [0, 3]), ("none", [])], "i string, p array<int>").select(files.page_count(F.col("i")), files.page_numbers(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(12, [1, 4]), (None, [])]


def test_rules(spark, tmp_path):
    (tmp_path / "vet.md").write_text(HEAD + "| Drugs | COGS | 1 | 2 | Name | 3 |\n| Label fee |  | 1 | 2 | Other | x |\n| short | a |\nend\n")
    got = [tuple(r)[:7] for r in files.rules(spark, f"{tmp_path}/vet.md").orderBy("seq").collect()]
    assert got == [("vet", "Drugs", "COGS", "1", "2", "Name", 3), ("vet", "Label fee", "", "1", "2", "Other", 1)]
    assert files.rules(spark, f"{tmp_path}/vet.md", compat=True).count() == 1
    sinks.write_rules(files.rules(spark, f"{tmp_path}/vet.md"), f"{tmp_path}/out")
    back = files.rules(spark, f"{tmp_path}/out/practice_id=vet").orderBy("seq").collect()
    assert [tuple(r)[1:7] for r in back] == [x[1:] for x in got]


def test_json_scans(spark, tmp_path):
    doc = {"title": "T", "statement_type": "cash_flow", "periods": ["2025"], "sections": [{"name": "A", "rows": [{"label": "x", "values": [None], "is_subtotal": False}]}]}
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=2))
    s = files.statements(spark, f"{tmp_path}/s.json")
    assert s.first().doc_id == "s" and s.first().sections[0].rows[0].label == "x"
    assert json.loads(s.select(sinks.statement_json(F.struct("title", "statement_type", "periods", "sections")).alias("j")).first().j) == doc
    other = s.withColumn("doc_id", F.lit("t"))
    both = sinks.preferred(s.unionByName(other), s.withColumn("title", F.lit("C")))
    assert {(r.doc_id, r.title) for r in both.collect()} == {("s", "C"), ("t", "T")}
    sinks.write_statements(both, f"{tmp_path}/w")
    assert spark.read.json(f"{tmp_path}/w").where("statement_type = 'cash_flow'").count() == 2
    (tmp_path / "coa.json").write_text(json.dumps([{"code": "9", "name": "b"}, {"code": "1", "name": "a", "description": "d"}]))
    assert [tuple(r) for r in files.accounts(spark, f"{tmp_path}/coa.json").collect()] == [("9", "b", None, 0), ("1", "a", "d", 1)]
    (tmp_path / "run.json").write_text(json.dumps({"run_id": "r", "success": True}, indent=1))
    assert files.runs(spark, f"{tmp_path}/run.json").where("modified is not null and success").count() == 1
    (tmp_path / "u.json").write_text(json.dumps({"users": {"a@b": {"tier": "pro", "current_month_count": 2}}}))
    assert [tuple(r) for r in files.usage(spark, f"{tmp_path}/u.json").collect()] == [("a@b", "pro", 2, None, None)]
    assert files.usage(spark, f"{tmp_path}/none.json").count() == 0


def test_stream_as_batch(spark, tmp_path):
    rows = [("2025-01-01 00:10:00", "call", "r", 5.0), ("2025-01-01 00:50:00", "call", "r", 7.0), ("2025-01-01 01:10:00", "save", "r", 1.0), ("2025-01-03 00:00:00", "call", "s", 2.0)]
    log = spark.createDataFrame(rows, "timestamp string, event string, run_id string, duration_ms double").withColumn("timestamp", F.to_timestamp("timestamp"))
    sinks.append_log(log, f"{tmp_path}/log")
    batch = events.windowed(files.event_log(spark, f"{tmp_path}/log"), "timestamp", "event", "duration_ms")
    assert sorted((str(r.window_start), r.kind, r.events, r.total_ms) for r in batch.collect()) == [("2025-01-01 00:00:00", "call", 2, 12.0), ("2025-01-01 01:00:00", "save", 1, 1.0), ("2025-01-03 00:00:00", "call", 1, 2.0)]
    stream = events.windowed(files.event_stream(spark, f"{tmp_path}/log"), "timestamp", "event", "duration_ms", late="1 hour")
    events.append_windows(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2  # the newest window is still open


def test_log_keeps_microseconds(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("run_id"), F.col("value").alias("duration_ms"))
    sinks.append_log(e, f"{tmp_path}/log")
    assert sorted(map(tuple, files.event_log(spark, f"{tmp_path}/log").drop("date").collect())) == sorted(map(tuple, e.collect()))


def test_usage_and_clean(spark, tmp_path):
    u = spark.createDataFrame([("a@b", "pro", 2, None, 5), ("c@d", "free", 0, "2025-01", 1)], "user_id string, tier string, current_month_count int, month_start string, total_extractions int")
    sinks.write_usage(u, f"{tmp_path}/usage")
    assert sorted(files.usage(spark, f"{tmp_path}/usage").collect()) == sorted(u.collect())
    for n in ("a.jpg", "b.jpg", "c.txt"):
        (tmp_path / n).write_text("x")
    assert sinks.clean(spark, str(tmp_path), "*.jpg") == 2 and (tmp_path / "c.txt").exists()
