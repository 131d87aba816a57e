"""Run tracking on a stream: late and repeated events, timers, a restart in between, the same rows as the whole log gives."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from finlattice.sources import sinks
from finlattice.streaming import runs

BEGIN = datetime.datetime(2025, 3, 1)


def log_of(n_runs=40, seed=5):
    """Events of runs that start a minute apart; every seventh has no end, every eleventh no start."""
    rng, out = random.Random(seed), []
    for i in range(n_runs):
        at = BEGIN + datetime.timedelta(minutes=i, microseconds=rng.randrange(10**6))
        step = lambda: datetime.timedelta(seconds=rng.randrange(1, 20), microseconds=rng.randrange(10**6))
        add = lambda kind, **more: out.append({"event_id": f"e{len(out)}", "timestamp": at, "event": kind, "run_id": f"r{i}", **more})
        if i % 11:
            add(runs.STARTED, pdf_file=f"{i}.pdf")
        for _ in range(rng.randrange(4)):
            at += step()
            add(runs.CALL, duration_ms=rng.randrange(10**6) / 100)
        for node in ("detect", "extract", "extract")[: rng.randrange(4)]:
            at += step()
            add(runs.NODE, node=node, duration_ms=rng.randrange(10**6) / 10)
        at += step()
        add(runs.EVALUATION, statement_type="cash_flow", score=float(rng.randrange(11)))
        if i % 7:
            at += step()
            add(runs.COMPLETED, success=i % 2 == 0, retry_count=i % 3, error_message=None if i % 2 == 0 else "bad")
    return out


def frame(spark, rows):
    names = [f.split()[0] for f in runs.EVENT.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], runs.EVENT).coalesce(1)


@pytest.mark.parametrize("parts", [1, 3])
def test_a_stream_gives_the_rows_of_the_log(spark, tmp_path, parts):
    rows = log_of()
    rng = random.Random(parts)
    late = sorted(rows, key=lambda r: r["timestamp"] + datetime.timedelta(seconds=rng.randrange(200)))  # up to some minutes late
    last = {"event_id": "z", "timestamp": BEGIN + datetime.timedelta(days=2), "event": "tick", "run_id": "none"}
    size = -(-len(late) // parts)
    for k in range(parts):  # each part is written and taken by a query of its own, which goes on where the one before ended
        part = late[k * size : (k + 1) * size]
        part = part + rng.sample(part, 5)  # repeated events
        sinks.append_log(frame(spark, part), f"{tmp_path}/log")
        if k == parts - 1:
            sinks.append_log(frame(spark, [last]), f"{tmp_path}/log")
        stream = runs.track(runs.event_stream(spark, f"{tmp_path}/log", 1 if parts > 1 else 1000), quiet_ms=600_000)
        runs.append_runs(stream, f"{tmp_path}/runs", f"{tmp_path}/cp").awaitTermination()
    want = sorted(map(tuple, runs.run_rows(frame(spark, rows)).collect()), key=str)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/runs").collect()), key=str)
    assert got == want
    assert {r[1] for r in got} == {"completed", "timed_out"} and len(got) == sum(1 for i in range(40) if i % 11)


def test_no_row_before_its_time(spark, tmp_path):
    rows = [r for r in log_of(3) if r["run_id"] == "r1"]
    sinks.append_log(frame(spark, rows), f"{tmp_path}/log")
    runs.append_runs(runs.track(runs.event_stream(spark, f"{tmp_path}/log")), f"{tmp_path}/runs", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.schema(runs.RUN).parquet(f"{tmp_path}/runs").count() == 0


def test_rows_of_a_log(spark):
    rows = log_of()
    df = frame(spark, rows + rows[:20])
    got = {r.run_id: r for r in runs.run_rows(df).collect()}
    one = [r for r in rows if r["run_id"] == "r5"]
    calls = [r["duration_ms"] for r in one if r["event"] == runs.CALL]
    assert got["r5"].llm_calls == len(calls) and got["r5"].llm_seconds == pytest.approx(sum(int(x + 0.5) for x in calls) / 1000)
    assert got["r5"].pdf_file == "5.pdf" and got["r5"].retry_count == 2 and got["r5"].success is False
    assert "r0" not in got and got["r7"].status == "timed_out"
    assert runs.run_rows(df.where(F.lit(False))).count() == 0
