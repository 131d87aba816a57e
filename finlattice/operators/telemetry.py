"""Run statistics, recent runs, call counters, quotas and quality counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def run_stats(runs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    r = runs.where(F.col("ts") > now - F.expr(f"interval {days} days"))
    return r.agg(F.count("*").alias("total_runs"), F.round(F.count_if("success") * 100 / F.count("*"), 1).alias("success_rate"), F.round(F.avg("seconds"), 2).alias("avg_seconds"), F.sum("calls").alias("calls"))


def recent(runs: DataFrame, limit: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("ts"), F.desc("run_id")).limit(limit)


def call_counters(events: DataFrame) -> DataFrame:
    """Per run: calls, seconds of calls (each rounded to ms) and each node's last value."""
    return events.groupBy("run_id").agg(F.count("*").alias("calls"), F.round(F.sum(F.round(F.col("ms") / 1000, 3)), 3).alias("seconds"), F.max_by("ms", F.struct("ts", "event_id")).alias("last_ms"))


def quota(attempts: DataFrame, limit: int = 2) -> DataFrame:
    """Attempts in order per user and month; a free user's attempts beyond `limit` are denied and don't count."""
    w = Window.partitionBy("user_id", "month").orderBy("ts", "event_id")
    n = F.row_number().over(w)
    return attempts.select("event_id", "user_id", "month", (F.col("pro") | (n <= limit)).alias("allowed"), F.when(F.col("pro"), n).otherwise(F.least(n, F.lit(limit))).cast("int").alias("used"), F.when(F.col("pro"), F.lit(None)).otherwise(F.greatest(F.lit(0), limit - n)).cast("int").alias("remaining"))


def quality_counters(rows: DataFrame, key: str) -> DataFrame:
    """Coverage, share of high confidence, review rate, and the rubric's points for them."""
    g = rows.groupBy(key).agg(F.count("*").alias("total"), F.count_if(~F.col("header")).alias("postable"), F.count_if(F.col("code").isNotNull() & ~F.col("header")).alias("mapped"), F.count_if((F.col("confidence") == "high") & F.col("code").isNotNull() & ~F.col("header")).alias("high"), F.count_if("needs_review").alias("review"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 3)
    g = g.withColumn("coverage", share("mapped", "postable")).withColumn("high_share", share("high", "mapped")).withColumn("review_rate", share("review", "total"))
    points = F.when(F.col("coverage") >= 0.9, 10).when(F.col("coverage") >= 0.7, 7).when(F.col("coverage") >= 0.5, 5).otherwise(0)
    return g.withColumn("coverage_points", points).withColumn("passed", F.col("coverage") >= 0.7)


def last_values(events: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """key, by_name: a map of each name's last value (by ts, event_id); repeated steps overwrite earlier ones."""
    g = events.groupBy(key, name).agg(F.max_by(value, F.struct("ts", "event_id")).alias("v"))
    return g.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "v")))).alias("by_name"))


def run_table(events: DataFrame) -> DataFrame:
    """One row per started run (run_id, event, ts, success): begin, end, seconds, success; ends without a start are left out."""
    begin, end = F.min(F.when(F.col("event") == "run_start", F.col("ts"))), F.max(F.when(F.col("event") == "run_end", F.col("ts")))
    won = F.max_by("success", F.when(F.col("event") == "run_end", F.col("ts")))
    g = events.groupBy("run_id").agg(begin.alias("started"), end.alias("ended"), won.alias("success")).where("started is not null")
    return g.withColumn("seconds", F.round(F.col("ended").cast("timestamp").cast("double") - F.col("started").cast("timestamp").cast("double"), 3))


def outcomes(results: DataFrame) -> DataFrame:
    """processed, failed, total over one row per document with its status."""
    return results.agg(F.count_if(F.col("status") == "processed").alias("processed"), F.count_if(F.col("status") != "processed").alias("failed"), F.count("*").alias("total"))


def trend(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The most recent runs, oldest first."""
    return recent(runs, limit).orderBy("ts", "run_id")


def dashboard(runs: DataFrame, now: Column, limit: int = 20, days: int = 7) -> DataFrame:
    """The most recent runs (run_id, ts, pdf_file, success, seconds, calls, retries), newest first, as a dashboard shows them, each with the last days' totals."""
    r = runs.where(F.col("ts") > now - F.expr(f"interval {days} days"))
    totals = r.agg(F.count("*").alias("total_runs"), F.round(F.count_if("success") * 100 / F.count("*"), 1).alias("success_rate"), F.round(F.avg("seconds"), 1).alias("avg_seconds"), F.round(F.avg("retries"), 2).alias("avg_retries"))
    shown = recent(runs, limit).select("run_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("shown_at"), "pdf_file", "success", "seconds", "calls", "retries")
    return shown.crossJoin(totals)  # one row


def file_counters(files: DataFrame) -> DataFrame:
    """extracted (documents with any output), xlsx and json files over output files (doc_id, name)."""
    return files.agg(F.countDistinct("doc_id").alias("extracted"), F.count_if(F.endswith("name", F.lit(".xlsx"))).alias("xlsx"), F.count_if(F.endswith("name", F.lit(".json"))).alias("json"))


def usage_state(usage: DataFrame, month: Column, limit: int = 2) -> DataFrame:
    """What a user may still do: user_id, tier, used (this month), allowed, remaining, progress; a new month starts at 0, pro has no limit."""
    used = F.when(F.col("month_start") == month, F.col("current_month_count")).otherwise(0)
    pro = F.col("tier") == "pro"
    left, share = quota_left(used, limit)
    return usage.select("user_id", "tier", used.alias("used"), (pro | (used < limit)).alias("allowed"), F.when(~pro, left).alias("remaining"), F.when(~pro, share).alias("progress"))


def quota_left(used: Column, limit: int = 2) -> tuple[Column, Column]:
    """What remains of a quota, and the share of it in use."""
    return F.greatest(F.lit(0), limit - used), used / limit


def output_types(files: DataFrame, types: list[str]) -> DataFrame:
    """name, statement_type, kind of output files whose name holds the name of a type, a row per file and type, with the files' other columns."""
    hit = F.filter(F.array(*map(F.lit, types)), lambda t: F.col("name").contains(t))
    return files.select("*", F.explode(hit).alias("statement_type"), F.lower(F.substring_index("name", ".", -1)).alias("kind"))


def observed_quality(rows: DataFrame, name: str = "quality") -> tuple[DataFrame, Observation]:
    """`rows` as they are, and the counters of quality_counters() over all of them, known once the rows have been written."""
    seen = Observation(name)
    posted = F.col("code").isNotNull() & ~F.col("header")
    counts = [F.count(F.lit(1)).alias("total"), F.count_if(~F.col("header")).alias("postable"), F.count_if(posted).alias("mapped"), F.count_if(posted & (F.col("confidence") == "high")).alias("high"), F.count_if("needs_review").alias("review")]
    return rows.observe(seen, *counts), seen


def observed_verdicts(verdicts: DataFrame, name: str = "verdicts") -> tuple[DataFrame, Observation]:
    """`verdicts` as they are; once written: statements, passed, whether all did, and the mean score."""
    seen = Observation(name)
    mean = F.try_divide(F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, x: a + x), F.size("scores"))
    ok = F.coalesce("passed", F.lit(False))
    return verdicts.observe(seen, F.count(F.lit(1)).alias("statements"), F.count_if(ok).alias("passed"), F.coalesce(F.bool_and(ok), F.lit(False)).alias("all_passed"), F.avg(mean).alias("score")), seen


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """key, started, ended, events, seconds of runs that say no end: one ends when nothing comes for `gap`.

    Batches and streams alike; `late` sets a stream's watermark. Rows without a key or time count nowhere.
    """
    e = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    e = e.withWatermark(ts, late) if late else e
    g = e.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("events"))
    return g.select(key, "started", "ended", "events", F.round((F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1000000, 3).alias("seconds"))


def sliding_stats(runs: DataFrame, days: int = 7, every: str = "1 day", late: str | None = None) -> DataFrame:
    """run_stats() of the `days` before each step: window_end, total_runs, success_rate, avg_seconds, calls. Batches and streams alike."""
    r = runs.withWatermark("ts", late) if late else runs
    g = r.groupBy(F.window("ts", f"{days} days", every).alias("w")).agg(F.count("*").alias("total_runs"), F.round(F.count_if("success") * 100 / F.count("*"), 1).alias("success_rate"), F.round(F.avg("seconds"), 2).alias("avg_seconds"), F.sum("calls").alias("calls"))
    return g.select(F.col("w.end").alias("window_end"), "total_runs", "success_rate", "avg_seconds", "calls")


def upgraded(usage: DataFrame, users: DataFrame, at: Column) -> DataFrame:
    """The usage table after `users` (user_id) became pro at a time; who wasn't known has used nothing yet."""
    u = users.select("user_id").distinct().withColumn("_pro", F.lit(True))
    old = usage if "upgraded_at" in usage.columns else usage.withColumn("upgraded_at", F.lit(None).cast("string"))
    j = old.join(u, "user_id", "full_outer")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("current_month_count", "total_extractions")}
    return j.withColumns(zero | {"tier": F.when(F.col("_pro"), "pro").otherwise(F.col("tier")), "month_start": F.coalesce("month_start", F.date_format(at, "yyyy-MM")), "upgraded_at": F.when(F.col("_pro"), at.cast("string")).otherwise(F.col("upgraded_at"))}).select(old.columns)


def recorded(usage: DataFrame, attempts: DataFrame, limit: int = 2) -> DataFrame:
    """The usage table after attempts (user_id, month as yyyy-MM): allowed ones count, a new month starts at 0.

    Free users may do `limit` a month, those of the month that the table is at included; pro users any number. Months
    before the table's own are late and leave its month as it is.
    """
    n = attempts.where("user_id is not null and month is not null").groupBy("user_id", "month").agg(F.count("*").cast("int").alias("n"))
    j = n.join(usage.select("user_id", "tier", "current_month_count", "month_start"), "user_id", "left")
    used = F.when(F.col("month") == F.col("month_start"), F.col("current_month_count")).otherwise(0)
    done = F.when(F.col("tier") == "pro", F.col("n")).otherwise(F.greatest(F.lit(0), F.least(F.col("n"), limit - used)))
    m = j.withColumn("used", used).withColumn("done", done).groupBy("user_id").agg(F.sum("done").cast("int").alias("_done"), F.max("month").alias("_month"), F.max_by(F.col("used") + F.col("done"), "month").cast("int").alias("_used"))
    out = usage.join(m, "user_id", "full_outer")
    newer = F.col("_month").isNotNull() & (F.col("_month") >= F.coalesce("month_start", F.lit("")))
    values = {"tier": F.coalesce("tier", F.lit("free")), "total_extractions": F.coalesce("total_extractions", F.lit(0)) + F.coalesce("_done", F.lit(0)), "current_month_count": F.when(newer, F.col("_used")).otherwise(F.col("current_month_count")), "month_start": F.when(newer, F.col("_month")).otherwise(F.col("month_start"))}
    return out.withColumns(values).select(usage.columns)
