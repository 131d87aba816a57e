"""Runs out of the event log: each run's events become one row when it has ended, or when nothing more is heard of it."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The log's events, beside the columns of any other kind of event.
EVENT = "event_id string, timestamp timestamp, event string, run_id string, node string, duration_ms double, statement_type string, score double, pdf_file string, success boolean, retry_count int, error_message string"
RUN = "run_id string, status string, started timestamp, ended timestamp, seconds double, pdf_file string, llm_calls long, llm_seconds double, node_timings map<string,double>, evaluation_scores map<string,double>, retry_count int, success boolean, error_message string"
STARTED, COMPLETED, NODE, CALL, EVALUATION = "run_started", "run_completed", "node_timing", "llm_call", "evaluation"
_NAMES = [f.split()[0] for f in EVENT.split(", ")]
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _whole_ms(ms: Column) -> Column:
    return F.floor(ms + 0.5)


def run_rows(events: DataFrame) -> DataFrame:
    """The same rows out of a whole log at once: a run whose end is in the log is completed, any other timed out.

    An event that is in the log twice (by event_id) counts once. Each node and type keeps its latest value, calls
    count their seconds rounded to milliseconds, and the latest end speaks for the run; ends without a start give no row.
    """
    e = events.select(*_NAMES).dropDuplicates(["event_id"])
    at = F.struct("timestamp", "event_id")
    is_ = lambda kind: F.col("event") == kind
    latest = lambda name, value, kind: e.where(is_(kind) & F.col(name).isNotNull()).groupBy("run_id", name).agg(F.max_by(value, at).alias("v")).groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "v")))).alias(f"of_{name}"))
    end = F.when(is_(COMPLETED), at)
    g = e.where("run_id is not null").groupBy("run_id").agg(
        F.min(F.when(is_(STARTED), F.col("timestamp"))).alias("started"),
        F.max(F.when(is_(COMPLETED), F.col("timestamp"))).alias("ended"),
        F.min_by("pdf_file", F.when(is_(STARTED), at)).alias("pdf_file"),
        F.count_if(is_(CALL)).alias("llm_calls"),
        (F.coalesce(F.sum(F.when(is_(CALL), _whole_ms(F.coalesce("duration_ms", F.lit(0.0))))), F.lit(0)) / 1000).alias("llm_seconds"),
        *(F.max_by(c, end).alias(c) for c in ("retry_count", "success", "error_message")),
    )
    none = F.create_map().cast("map<string,double>")
    g = g.where("started is not null").join(latest("node", _whole_ms(F.col("duration_ms")) / 1000, NODE), "run_id", "left").join(latest("statement_type", "score", EVALUATION), "run_id", "left")
    seconds = F.round((F.unix_micros("ended") - F.unix_micros("started")) / 1000000, 2)
    return g.select("run_id", F.when(F.col("ended").isNull(), "timed_out").otherwise("completed").alias("status"), "started", "ended", seconds.alias("seconds"), "pdf_file", "llm_calls", "llm_seconds", F.coalesce("of_node", none).alias("node_timings"), F.coalesce("of_statement_type", none).alias("evaluation_scores"), "retry_count", "success", "error_message")


class RunTracker(StatefulProcessor):
    """One row per run. A key is a bucket of runs; its state is what is known of each open run, with the latest value of each node and statement type.

    A run is due `grace_ms` after its end, for late events, or `quiet_ms` after its last event if it has none; a bucket's
    timer waits for the first of its runs. So the calls for state and timers go by bucket, and not by run or event.
    """

    def __init__(self, grace_ms: int, quiet_ms: int):
        self.grace_ms, self.quiet_ms = grace_ms, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # JSON, by run: started, start_id, pdf_file, ended, end_id, success, retry_count, error_message, last, calls, call_ms, nodes, scores
        # times in microseconds; the order of ends, starts and values is that of (time, event_id)
        self.open = handle.getValueState("open", "runs string, timer long")

    def due(self, s: list) -> int:
        return s[3] // 1000 + self.grace_ms if s[3] is not None else s[8] // 1000 + self.quiet_ms

    def wait(self, known: dict, timer: int | None) -> None:
        """Write the bucket's runs, with a timer for the first that is due; `timer` is the one that waits now."""
        if not known:
            self.open.clear()
            return
        first = min(map(self.due, known.values()))
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        self.open.update((json.dumps(known), first))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.open.get()
        known, timer = (json.loads(state[0]), state[1]) if state is not None else ({}, None)
        for f in rows:
            f = f[f["timestamp"].notna()]
            at = f["timestamp"].astype("datetime64[us]" if f["timestamp"].dt.tz is None else "datetime64[us, UTC]").astype("int64")
            plain = (f[c].astype(object).where(f[c].notna(), None) for c in ("run_id", "event", "event_id", "node", "duration_ms", "statement_type", "score", "pdf_file", "success", "retry_count", "error_message"))
            for us, run, event, name, node, ms, kind, score, pdf, success, retries, error in zip(at.tolist(), *(c.tolist() for c in plain)):
                name = name or ""
                s = known.setdefault(run, [None] * 8 + [0, 0, 0, {}, {}])
                s[8] = max(s[8], us)
                if event == STARTED and (s[0] is None or (us, name) < (s[0], s[1])):
                    s[:3] = us, name, pdf
                elif event == COMPLETED and (s[3] is None or (us, name) > (s[3], s[4])):
                    s[3:8] = us, name, None if success is None else bool(success), None if retries is None else int(retries), error
                elif event == CALL:
                    s[9] += 1
                    s[10] += 0 if ms is None else math.floor(ms + 0.5)
                elif event in (NODE, EVALUATION):
                    latest, what, value = (s[11], node, None if ms is None else math.floor(ms + 0.5) / 1000) if event == NODE else (s[12], kind, None if score is None else float(score))
                    if what is not None and (what not in latest or (us, name) > tuple(latest[what][:2])):
                        latest[what] = [us, name, value]
        self.wait(known, timer)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.open.get()
        known = json.loads(state[0]) if state is not None else {}
        now = timerValues.getCurrentWatermarkInMs()
        ended = {run: s for run, s in known.items() if self.due(s) <= now}
        timer = expiredTimerInfo.getExpiryTimeInMs()
        self.wait({run: s for run, s in known.items() if run not in ended}, None if state is None or state[1] == timer else state[1])
        time = lambda us: None if us is None else datetime.fromtimestamp(us // 1_000_000, timezone.utc).replace(microsecond=us % 1_000_000)
        out = [(run, "timed_out" if s[3] is None else "completed", time(s[0]), time(s[3]), None if s[3] is None else round((s[3] - s[0]) / 1e6, 2), s[2], s[9], s[10] / 1000, *({k: v[2] for k, v in m.items()} for m in s[11:]), s[6], s[5], s[7]) for run, s in ended.items() if s[0] is not None]
        if not out:
            return iter([])
        f = pd.DataFrame(out, columns=[c.split()[0] for c in RUN.replace("map<string,double>", "m").split(", ")])
        for c in ("started", "ended"):
            f[c] = pd.to_datetime(f[c], utc=True)
        return iter([f.astype({"retry_count": "Int32", "success": "boolean"})])

    def close(self) -> None:
        pass


def track(events: DataFrame, late: str = "10 minutes", grace_ms: int = 60_000, quiet_ms: int = 3_600_000, buckets: int = 4096) -> DataFrame:
    """run_rows() of a stream of events: a run's row comes once the newest event is `late` past its timer.

    Events up to `late` behind the newest count; repeated ones (event_id) are dropped meanwhile. State is a row and two
    small maps per open run, kept in `buckets` of runs, a number that a checkpoint is tied to. A run id that starts again
    after its row is a new run.
    """
    events.sparkSession.conf.set(*PROVIDER)  # keyed state with timers needs it
    e = events.select(*_NAMES).where("run_id is not null and timestamp is not null")
    e = e.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["event_id"])
    bucket = F.pmod(F.xxhash64("run_id"), F.lit(buckets)).alias("bucket")
    return e.select(bucket, *_NAMES).groupBy("bucket").transformWithStateInPandas(RunTracker(grace_ms, quiet_ms), RUN, "append", "EventTime")


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The log that sinks.append_log writes, as a stream with all columns of EVENT."""
    raw = spark.readStream.schema(EVENT.replace("timestamp timestamp", "timestamp string")).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return raw.withColumn("timestamp", F.col("timestamp").try_cast("timestamp"))


def append_runs(runs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write finished runs as Parquet; takes what is there, then stops. A restart goes on at the checkpoint."""
    return runs.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
