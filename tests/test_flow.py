"""Ledgers, caches, journals, ingest and versioned rules: what is done once stays done."""

import functools
import json
import os
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from finlattice.plans import workflow
from finlattice.plans.flow import AnswerCache, Flow, Journal, Ledger, Pace
from finlattice.plans.versions import Conflict, RuleTable, VersionedTable
from finlattice.streaming import ingest as I
from finlattice.streaming import runs


def answer(log, prompts, images):
    """A model that notes what it is asked."""
    out = []
    for p in prompts:
        kind = "detect" if "Which pages" in p else "extract" if "Give the" in p else "judge"
        with open(os.path.join(log, f"{kind}-{uuid.uuid4().hex}"), "w") as f:
            f.write(p)
        if kind == "detect":
            out.append('{"income_statement": [1, 2]}')
        elif kind == "extract":
            out.append(json.dumps({"title": "T", "periods": ["2024"], "sections": [{"name": "S", "rows": [{"label": p[-6:], "values": ["1"], "is_subtotal": False}]}]}))
        else:
            out.append(json.dumps({"scores": {"a": 8, "b": 6}, "passed": "poor" not in p, "feedback": "x"}))
    return out


def asked(log):
    return sorted(x.split("-")[0] for x in os.listdir(log))


def pages(spark, n=3):
    return spark.createDataFrame([(f"d{i}", k, f"{'page ' * 30} {i} {k:05d}") for i in range(n) for k in (1, 2)], "doc_id string, page_num int, text string")


class Killed(Exception):
    pass


class Fragile(Ledger):
    """A ledger whose driver dies before the stage `at` is written."""

    at = "verdicts"

    def __call__(self, df, name):
        if name == self.at:
            raise Killed(name)
        return super().__call__(df, name)


def model(tmp_path, name):
    (tmp_path / name).mkdir()
    return functools.partial(answer, str(tmp_path / name))


def test_a_killed_run_goes_on_at_its_stage(spark, tmp_path):
    m, whole = model(tmp_path, "m"), model(tmp_path, "whole")
    want = sorted(map(str, workflow.run(pages(spark), whole, whole).statements.collect()))
    with pytest.raises(Killed):
        workflow.run(pages(spark), m, m, flow=Flow(Fragile(spark, f"{tmp_path}/run")))
    before = asked(tmp_path / "m")
    ledger = Ledger(spark, f"{tmp_path}/run")
    got = workflow.run(pages(spark), m, m, flow=Flow(ledger))
    assert sorted(map(str, got.statements.collect())) == want and asked(tmp_path / "m") == asked(tmp_path / "whole")
    assert before.count("extract") == 6 and ledger.made[0] == "verdicts-01"
    assert ledger.stages()[0] == ("detect-text", 1) and ("verdicts", 1) in ledger.stages()
    ledger.clear()
    assert not (tmp_path / "run").exists()


def test_a_second_run_asks_nothing(spark, tmp_path):
    m = model(tmp_path, "m")
    flow = lambda: Flow(caches={m: AnswerCache(spark, f"{tmp_path}/cache", "any/model")})
    doubled = pages(spark).unionByName(pages(spark, 1).withColumn("doc_id", F.lit("copy")))  # d0 once more
    first = sorted(map(str, workflow.run(doubled, m, m, flow=flow()).statements.collect()))
    n = asked(tmp_path / "m")
    assert n.count("extract") == 6 and n.count("detect") == 3  # equal prompts are asked once
    assert sorted(map(str, workflow.run(doubled, m, m, flow=flow()).statements.collect())) == first and asked(tmp_path / "m") == n
    other = Flow(caches={m: AnswerCache(spark, f"{tmp_path}/cache", "other")})
    workflow.detect(pages(spark), m, flow=other).collect()
    assert len(asked(tmp_path / "m")) == len(n) + 3


def test_the_log_of_a_run_gives_its_metrics(spark, tmp_path):
    m = model(tmp_path, "m")
    journal = Journal(f"{tmp_path}/logs", "one")
    result = workflow.run(pages(spark), m, m, flow=Flow(journal=journal))
    got = {r.pdf_file: r for r in journal.metrics(spark).collect()}
    assert set(got) == {"d0", "d1", "d2"} and all(r.status == "completed" and r.success and r.seconds >= 0 for r in got.values())
    assert all(r.llm_calls == 4 and set(r.node_timings) == {"detect-text", "extract", "judge"} and r.evaluation_scores == {"income_statement": 7.0} and r.retry_count == 0 for r in got.values())
    again = Journal(f"{tmp_path}/logs", "one")  # the same run told again, as after a kill
    again.started(pages(spark))
    again.completed(result.outcome, result.verdicts)
    assert {r.pdf_file: r.llm_calls for r in again.metrics(spark).collect()} == {d: 4 for d in got}
    assert spark.read.json(f"{tmp_path}/logs").where(F.col("event") == runs.CALL).count() == 12


def test_pace(monkeypatch):
    slept = []
    monkeypatch.setattr("finlattice.plans.flow.time.sleep", slept.append)
    p = Pace(lambda prompts, images: prompts, 1000.0)
    assert p(["a"] * 500, []) == ["a"] * 500 and p(["b"], []) == ["b"]
    assert slept[0] <= 0.001 and slept[1] == pytest.approx(0.5, abs=0.1)


def read(content):
    return bytes(content).decode().split("|")


def process_with(m, out, keep_of=lambda k: k):
    from finlattice.__main__ import pages_of, save

    def process(docs, ledger, batch):
        keep = keep_of(ledger)
        result = workflow.run(keep(pages_of(docs, read, None), "pages"), m, m, flow=Flow(keep))
        at = keep(docs.sparkSession.range(1).select(F.lit("2025-01-01").cast("timestamp").alias("at")), "time").first()["at"]
        save(result, out, F.lit(at), batch)

    return process


def contents(out):
    import zipfile

    def seen(f):
        if f.suffix != ".xlsx":
            return sorted(f.read_text().splitlines())
        with zipfile.ZipFile(f) as z:
            return z.read("xl/worksheets/sheet1.xml").decode()

    return sorted((f.name if f.suffix == ".xlsx" else f.parent.name, str(seen(f))) for f in out.rglob("*") if f.suffix in (".json", ".xlsx") and not any(p.startswith("_") for p in f.relative_to(out).parts) and f.stat().st_size)


def test_a_killed_ingest_gives_the_files_of_an_undisturbed_one(spark, tmp_path):
    drop = tmp_path / "in"
    drop.mkdir()
    for i in range(3):
        (drop / f"d{i}.pdf").write_bytes(f"{'page ' * 30} {i} 00001|{'page ' * 30} {i} 00002".encode())
    m, whole = model(tmp_path, "m"), model(tmp_path, "whole")
    I.ingest(spark, str(drop), f"{tmp_path}/whole-out", process_with(whole, f"{tmp_path}/whole-out")).awaitTermination()
    out = f"{tmp_path}/out"

    def dying(ledger):
        return Fragile(ledger.spark, ledger.folder)

    with pytest.raises(Exception, match="verdicts"):
        I.ingest(spark, str(drop), out, process_with(m, out, dying)).awaitTermination()
    assert I.settled(spark, out).count() == 0 and contents(tmp_path / "out") == []
    before = asked(tmp_path / "m")
    I.ingest(spark, str(drop), out, process_with(m, out)).awaitTermination()
    assert contents(tmp_path / "out") == contents(tmp_path / "whole-out") != []
    assert before.count("extract") == asked(tmp_path / "m").count("extract") == 6 and asked(tmp_path / "m") == asked(tmp_path / "whole")
    n = asked(tmp_path / "m")
    I.ingest(spark, str(drop), out, process_with(m, out)).awaitTermination()  # nothing new
    I.batch_of(process_with(m, out), out)(spark.read.format("binaryFile").load(str(drop)), 0)  # a batch given again
    I.batch_of(process_with(m, out), out)(spark.read.format("binaryFile").load(str(drop)), 77)  # its documents given in another
    assert asked(tmp_path / "m") == n and contents(tmp_path / "out") == contents(tmp_path / "whole-out")
    (drop / "late.pdf").write_bytes(f"{'page ' * 30} 9 00001".encode())
    I.ingest(spark, str(drop), out, process_with(m, out)).awaitTermination()
    assert I.settled(spark, out).count() == 4 and len([c for c in contents(tmp_path / "out") if c[0].startswith("late_")]) == 1


RULE = "practice_id string, label string, section string, wrong_code string, correct_code string, correct_name string, seq long"


def test_concurrent_appends_lose_no_count(spark, tmp_path):
    gate, failed = threading.Barrier(3), []

    def work(who):
        try:
            table = RuleTable(spark, f"{tmp_path}/rules")
            gate.wait()
            for k in range(3):
                table.append(spark.createDataFrame([("p", "Rent", "OPEX", "1", f"{who}{k}", "n", 0), ("p", "RENT", "opex", "1", "2", "n", 1), (f"q{who}", "Fuel", None, "3", "4", "n", 0)], RULE))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(w,)) for w in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert failed == []
    table = RuleTable(spark, f"{tmp_path}/rules")
    assert table.version() == 9
    assert {(r.practice_id, r.label): r["count"] for r in table.read().collect()} == {("p", "Rent"): 18, **{(f"q{w}", "Fuel"): 3 for w in range(3)}}
    assert [table.read(v).agg(F.sum("count")).first()[0] for v in (1, 5)] == [3, 15]
    assert table.vacuum(2) == 7 and table.read().count() == 4 and table.version() == 9
    assert len(os.listdir(tmp_path / "rules" / "data")) == 2


def test_rules_of_practices(spark, tmp_path):
    table = RuleTable(spark, f"{tmp_path}/rules")
    assert table.read().count() == 0 and table.version() == 0
    table.append(spark.createDataFrame([("p", "Rent", "OPEX", "1", "7", "seven", 0), ("p", "Fuel", "OPEX", "2", "8", "eight", 1)], RULE))
    table.append(spark.createDataFrame([("p", "New", "X", "5", "6", "six", 0), ("p", "rent", "opex", "9", "10", "ten", 1)], RULE))
    got = [tuple(r) for r in table.of("p").orderBy("seq").collect()]
    assert got == [("p", "Rent", "OPEX", "1", "10", "ten", 2, 0), ("p", "Fuel", "OPEX", "2", "8", "eight", 1, 1), ("p", "New", "X", "5", "6", "six", 1, 2)]


def test_a_number_is_taken_once(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", "a int")
    spark.range(1).select(F.lit(1).alias("a")).write.parquet(f"{tmp_path}/t/data/x")
    t._take(1, "x")
    with pytest.raises(Conflict):
        t._take(1, "y")
    assert t.version() == 1 and [r.a for r in t.read().collect()] == [1]
