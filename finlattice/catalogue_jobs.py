"""Queries of the library's jobs: streams, versioned tables, caches, data sources and the command line, over files made from the tables.

Each job works in a fresh folder of the cluster's shared one, which goes when the driver ends.
"""

from __future__ import annotations

import contextlib
import io
import json
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import catalogue_more
from .catalogue import _PEERS, ORACLES, QUERIES, _peer_cells, query, t
from .operators import matching, telemetry
from .plans import comparison, workflow
from .plans.flow import AnswerCache, Flow
from .plans.tables import kept, shared_folder
from .plans.versions import RuleTable
from .sources import files, sinks, spreadsheets, workbook
from .streaming import ingest, runs

__all__ = ["ORACLES", "QUERIES", "catalogue_more"]


def _folder(spark, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


# -- runs: every user's day is a run, told by the kinds of events

_KINDS = {"signup": runs.STARTED, "purchase": runs.COMPLETED, "click": runs.CALL, "view": runs.NODE, "error": runs.EVALUATION}
_RUN = "user_id || '-' || strftime(ts, '%Y%m%d')"
_RUN_ROWS = f"""with e as (select {_RUN} as run_id, event_id, ts, epoch_us(ts) as us, event_type as k, value, event_id % 3 as m from events),
g as (select run_id, min(ts) filter (k = 'signup') as started, max(ts) filter (k = 'purchase') as ended, max(us) as last, count(*) filter (k = 'click') as llm_calls, coalesce(sum(floor(value + 0.5)) filter (k = 'click'), 0) / 1000 as llm_seconds,
  arg_max(event_id % 3, ts) filter (k = 'purchase') as retry_count, arg_max(event_id % 2 = 0, ts) filter (k = 'purchase') as success, arg_max(floor(value + 0.5) / 1000, ts) filter (k = 'view' and m = 0) as n0, arg_max(floor(value + 0.5) / 1000, ts) filter (k = 'view' and m = 1) as n1,
  arg_max(value, ts) filter (k = 'error' and event_id % 2 = 0) as s0 from e group by 1 having min(ts) filter (k = 'signup') is not null),
r as (select *, case when ended is null then 'timed_out' else 'completed' end as status, round((epoch_us(ended) - epoch_us(started)) / 1000000, 2) as seconds, case when ended is null then last // 1000 + 3600000 else epoch_us(ended) // 1000 + 60000 end as due from g)
select run_id, status, started, ended, seconds, llm_calls, llm_seconds, retry_count::int as retry_count, success, n0, n1, s0 from r"""


def _log(e):
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    kind = F.create_map(*(F.lit(x) for kv in _KINDS.items() for x in kv))[F.col("event_type")]
    run = F.concat_ws("-", "user_id", F.date_format(ts, "yyyyMMdd"))
    values = {"event_id": k.cast("string"), "timestamp": ts, "event": kind, "run_id": run, "node": F.concat(F.lit("n"), k % 3), "duration_ms": F.col("value"), "statement_type": F.concat(F.lit("s"), k % 2), "score": F.col("value"), "success": k % 2 == 0, "retry_count": (k % 3).cast("int"), "pdf_file": F.lit("f"), "error_message": F.lit(None).cast("string")}
    return e.select(*(values[f.split()[0]].alias(f.split()[0]) for f in runs.EVENT.split(", ")))


def _shown(r):
    return r.select("run_id", "status", "started", "ended", "seconds", "llm_calls", "llm_seconds", "retry_count", "success", F.col("node_timings")["n0"].alias("n0"), F.col("node_timings")["n1"].alias("n1"), F.col("evaluation_scores")["s0"].alias("s0"))


@query(_RUN_ROWS)
def run_metrics(spark, sf):
    """The whole log at once."""
    return _shown(runs.run_rows(_log(t(spark, sf, "events"))))


@query(f"{_RUN_ROWS} where due <= (select max(us) // 1000 - 600000 from e)")
def tracked_runs(spark, sf):
    """The same log as a stream: the runs whose timers ran out before its end."""
    to = _folder(spark, "tracked-runs")
    stream = spark.readStream.schema(t(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    runs.append_runs(runs.track(_log(stream)), f"{to}/runs", f"{to}/checkpoint").awaitTermination()
    return _shown(spark.read.schema(runs.RUN).parquet(f"{to}/runs"))


@query("""with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from o)
select user_id, min(ts) as started, max(ts) as ended, count(*) as events, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000, 3) as seconds from s group by user_id, n""")
def session_runs(spark, sf):
    return telemetry.sessions(t(spark, sf, "events"), "user_id", "ts")


@query("""with w as (select unnest(generate_series(date_trunc('day', (select min(ts) from events)) + interval 1 day, (select max(ts) from events) + interval 7 days, interval 1 day)) as window_end)
select window_end, count(*) as total_runs, round(count(*) filter (event_type <> 'error') * 100 / count(*), 1) as success_rate, round(avg(value), 2) as avg_seconds, sum(event_id % 7)::bigint as calls from w join events on ts >= window_end - interval 7 days and ts < window_end group by 1""")
def sliding_stats(spark, sf):
    r = t(spark, sf, "events").select("ts", (F.col("event_type") != "error").alias("success"), F.col("value").alias("seconds"), (F.col("event_id") % 7).alias("calls"))
    return telemetry.sliding_stats(r)


@query("select count(*) as total, count(*) filter (event_type <> 'view') as postable, count(*) filter (event_id % 4 > 0 and event_type <> 'view') as mapped, count(*) filter (event_id % 4 > 0 and event_type <> 'view' and event_id % 3 = 0) as high, count(*) filter (event_id % 5 = 0) as review from events")
def observed_quality(spark, sf):
    """Counters seen while the rows are written, without a scan of their own."""
    k = F.col("event_id")
    rows = t(spark, sf, "events").select((F.col("event_type") == "view").alias("header"), F.when(k % 4 > 0, "1").alias("code"), F.when(k % 3 == 0, "high").otherwise("low").alias("confidence"), (k % 5 == 0).alias("needs_review"))
    rows, seen = telemetry.observed_quality(rows)
    kept(rows, "observed")
    return spark.createDataFrame([seen.get])


# -- usage, rules, answers

_USAGE = "select user_id::varchar as user_id, case when user_id % 5 = 0 then 'pro' else 'free' end as tier, (user_id % 3)::int as current_month_count, case when user_id % 2 = 0 then '2024-01' else '2023-12' end as month_start, (user_id * 3)::int as total_extractions from (select distinct user_id from events where user_id % 4 > 0)"


def _usage(spark, sf):
    u = t(spark, sf, "events").select("user_id").where("user_id % 4 > 0").distinct()
    k = F.col("user_id")
    return u.select(k.cast("string").alias("user_id"), F.when(k % 5 == 0, "pro").otherwise("free").alias("tier"), (k % 3).cast("int").alias("current_month_count"), F.when(k % 2 == 0, "2024-01").otherwise("2023-12").alias("month_start"), (k * 3).cast("int").alias("total_extractions"))


@query(f"""with u as ({_USAGE}), p as (select distinct user_id::varchar as user_id from events where event_type = 'purchase' and user_id % 3 = 0)
select coalesce(u.user_id, p.user_id) as user_id, case when p.user_id is not null then 'pro' else tier end as tier, coalesce(current_month_count, 0) as current_month_count, coalesce(month_start, '2024-02') as month_start, coalesce(total_extractions, 0) as total_extractions, case when p.user_id is not null then '2024-02-03 00:00:00' end as upgraded_at from u full join p on u.user_id = p.user_id""")
def upgraded_usage(spark, sf):
    pro = t(spark, sf, "events").where("event_type = 'purchase' and user_id % 3 = 0").select(F.col("user_id").cast("string").alias("user_id"))
    return telemetry.upgraded(_usage(spark, sf), pro, F.lit("2024-02-03").cast("timestamp_ntz"))


@query(f"""with u as ({_USAGE}), n as (select user_id::varchar as user_id, count(*)::int as n from events group by 1),
j as (select coalesce(u.user_id, n.user_id) as user_id, coalesce(tier, 'free') as tier, case when month_start = '2024-01' then current_month_count else 0 end as used, coalesce(total_extractions, 0) as total, n from u full join n on u.user_id = n.user_id),
d as (select *, case when tier = 'pro' then n else greatest(0, least(n, 2 - used)) end as done from j)
select user_id, tier, (used + done)::int as current_month_count, '2024-01' as month_start, (total + done)::int as total_extractions from d""")
def recorded_usage(spark, sf):
    return telemetry.recorded(_usage(spark, sf), t(spark, sf, "events").select(F.col("user_id").cast("string").alias("user_id"), F.lit("2024-01").alias("month")))


@query("""select 'practice' || user_id % 7 as practice_id, event_type as label, 'S' || user_id % 3 as section, arg_min(event_id % 11, (event_id % 3, event_id))::varchar as wrong_code, arg_max(event_id % 13, (event_id % 3, event_id))::varchar as correct_code, count(*) as count from events group by 1, 2, 3""")
def rule_versions(spark, sf):
    """Corrections of three days, each a version of the rule table."""
    table, k = RuleTable(spark, _folder(spark, "rules")), F.col("event_id")
    e = t(spark, sf, "events").select(F.concat(F.lit("practice"), F.col("user_id") % 7).alias("practice_id"), F.col("event_type").alias("label"), F.concat(F.lit("S"), F.col("user_id") % 3).alias("section"), (k % 11).cast("string").alias("wrong_code"), (k % 13).cast("string").alias("correct_code"), F.lit("n").alias("correct_name"), k.alias("seq"), (k % 3).alias("day"))
    for day in range(3):
        table.append(e.where(F.col("day") == day).drop("day"))
    return table.read().select("practice_id", "label", "section", "wrong_code", "correct_code", "count")


def _upper(prompts, images):
    return [p.upper() for p in prompts]


@query("select p_partkey, upper(p_name) as answer, false as asked from part where p_name is not null")
def cached_answers(spark, sf):
    """Names asked about twice; the second time every answer is known."""
    flow = Flow(caches={_upper: AnswerCache(spark, _folder(spark, "answers"), "upper")})
    requests = t(spark, sf, "part").select("p_partkey", F.col("p_name").alias("prompt"))
    flow.ask(requests, _upper, "first")
    return flow.ask(requests, _upper, "second").select("p_partkey", "answer", (F.col("ms") > 0).alias("asked"))


@query("""with a as (select p_name, min(p_partkey) as k from part where p_partkey % 2 = 1 group by 1), l as (select distinct p_name as label from part)
select label, '5' || lpad(min(k)::varchar, 8, '0') as code from l join a on contains(p_name, label) or contains(label, p_name) group by 1""")
def income_accounts_only(spark, sf):
    """allow_balance_sheet=False: of accounts named like parts, those of the balance sheet (every second, and first in order) never match."""
    k = F.col("p_partkey")
    part = t(spark, sf, "part")
    chart = part.select(F.concat(F.when(k % 2 == 0, "1").otherwise("5"), F.lpad(k.cast("string"), 8, "0")).alias("code"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("description"), F.when(k % 2 == 0, k - 1_000_000_000).otherwise(k).cast("int").alias("pos"))
    m = matching.match(part.select(F.col("p_name").alias("label")), chart, allow_balance_sheet=False)
    return m.where("match_type in ('exact', 'exact_substring')").select("label", "code")


# -- files made from tables, and what the scans, writers and the command line make of them

_CELLS = "select 'c' || o_custkey || '.xlsx' as name, 'Orders' as sheet, n::int as row_no, c::int as col_no, case c when 1 then o_orderkey::varchar else o_orderpriority end as value from (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders), (select unnest([1, 2]) as c)"


@query(f"{_CELLS} where n % 2 = 1 or c = 2")
def spreadsheet_source(spark, sf):
    """A spreadsheet per customer, written by the executors and read again through the data source."""
    o = t(spark, sf, "orders").withColumn("row_no", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    cell = lambda i, c: F.struct(F.lit(i).alias("col_no"), F.col(c).cast("string").alias("value"), F.lit("plain").alias("style"))
    to = _folder(spark, "spreadsheets")
    spreadsheets.save(workbook.files(o.select(F.concat(F.lit("c"), "o_custkey", F.lit(".xlsx")).alias("name"), F.lit("Orders").alias("sheet"), "row_no", F.inline(F.array(cell(1, "o_orderkey"), cell(2, "o_orderpriority"))))), to, per_folder=1000)
    return spreadsheets.cells(spark, to).where("row_no % 2 = 1 or col_no = 2").select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "sheet", "row_no", "col_no", "value")


def _dropped(spark, sf, per_folder=0):
    """A report per supplier, with a part named after a statement beside every third, in a fresh folder."""
    s = t(spark, sf, "supplier").select(F.replace("s_name", F.lit("#"), F.lit("_")).alias("name"), F.col("s_suppkey").alias("k"), F.concat(F.rpad(F.concat("s_name", F.lit(" ")), 120, "report "), F.lit("|"), F.col("s_nationkey").cast("string")).alias("text"))
    whole = s.select(F.concat("name", F.lit(".pdf")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    parts = s.where("k % 3 = 0").select(F.concat("name", F.lit("_cash_flow.pdf")).alias("name"), F.encode(F.lit("x"), "UTF-8").alias("content"))
    to = _folder(spark, "dropped")
    spreadsheets.save(whole.unionByName(parts), to, per_folder)
    return to


_NAME = "replace(s_name, '#', '_')"


@query(f"select {_NAME} as stem from supplier")
def dropped_reports(spark, sf):
    """Reports of a folder: those named after a statement are parts of others."""
    return files.reports(spark, _dropped(spark, sf)).select("stem")


@query(f"select {_NAME} || '_cash_flow' as stem from supplier where s_suppkey = 3")
def outputs_of_a_report(spark, sf):
    name = t(spark, sf, "supplier").where("s_suppkey = 3").select(F.replace("s_name", F.lit("#"), F.lit("_")).alias("n")).first()["n"]
    return files.outputs_of(spark, _dropped(spark, sf), name).select("stem")


@query(f"select {_NAME} as stem, (select count(*) from supplier where s_suppkey % 3 = 0)::int as gone from supplier")
def cleaned_folder(spark, sf):
    folder = _dropped(spark, sf)
    gone = sinks.clean(spark, folder, "*_cash_flow.pdf")
    return files.listed(spark, folder).select("stem", F.lit(gone).alias("gone"))


def _pages_of(content):
    return bytes(content).decode().split("|")


def _model(prompts, images):
    """Page 1 holds an income statement whose only row is labelled by the page's first word."""
    out = []
    for p in prompts:
        if "Which pages" in p:
            out.append('{"income_statement": [1]}')
        elif "Give the" in p:
            rows = [{"label": p.splitlines()[-1].split()[0], "values": [str(len(p.splitlines()[-1]))], "is_subtotal": False}]
            out.append(json.dumps({"title": "T", "periods": ["2024"], "sections": [{"name": "S", "rows": rows}]}))
        else:
            out.append('{"scores": {"a": 9}, "passed": true}')
    return out


_STATEMENTS = f"select {_NAME} as doc_id, 'income_statement' as statement_type, split_part(s_name, ' ', 1) as label, '120' as figure from supplier"


def _saved(spark, out):
    s = spark.read.schema("doc_id string, statement_type string, sections " + workflow.SECTIONS).json(f"{out}/json")
    return s.select("doc_id", "statement_type", F.col("sections")[0]["rows"][0]["label"].alias("label"), F.col("sections")[0]["rows"][0]["values"][0].alias("figure"))


@query(_STATEMENTS)
def command_line(spark, sf):
    """The command line over a folder of reports; what it saved, read again."""
    from .__main__ import main

    out = _folder(spark, "command")
    with contextlib.redirect_stdout(io.StringIO()):
        main(["--folder", _dropped(spark, sf), "--out", out, "--reader", "finlattice.catalogue_jobs:_pages_of", "--model", "finlattice.catalogue_jobs:_model"], spark)
    return _saved(spark, out)


@query(_STATEMENTS)
def ingested_reports(spark, sf):
    """The same as a stream of batches, called twice; nothing is taken twice."""
    from .__main__ import pages_of, save

    out, folder = _folder(spark, "ingested"), _dropped(spark, sf, per_folder=1000)

    def process(docs, ledger, batch):
        result = workflow.run(ledger(pages_of(docs, _pages_of, None), "pages"), _model, _model, flow=Flow(ledger))
        save(result, out, F.lit("2025-01-01").cast("timestamp"), batch)

    for _ in range(2):
        ingest.ingest(spark, folder, out, process, bytes_per_trigger=256 << 20).awaitTermination()
    return _saved(spark, out)


@query(_PEERS)
def compared_files(spark, sf):
    """Statements written as files, one per company, compared by compare_files and read from what that saved."""
    c = _peer_cells(spark, sf)
    row = F.struct("row_pos", "label", F.array("value_raw").alias("values"), F.lit(False).alias("is_subtotal"))
    s = c.groupBy("company").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r.dropFields("row_pos")).alias("rows"))
    text = sinks.statement_json(F.struct(F.lit("T").alias("title"), F.lit("income_statement").alias("statement_type"), F.array(F.lit("2024")).alias("periods"), F.array(F.struct(F.lit("S").alias("name"), "rows")).alias("sections")))
    folder = _folder(spark, "compared")
    spreadsheets.save(s.select(F.concat("company", F.lit(".json")).alias("name"), F.encode(text, "UTF-8").alias("content")), f"{folder}/in")
    names = [r.n_name for r in t(spark, sf, "nation").select("n_name").collect()]  # some dozen companies
    here = {r.stem for r in files.listed(spark, f"{folder}/in").select("stem").collect()}
    out = comparison.compare_files(spark, {n: f"{folder}/in/{n}.json" for n in names if n in here}, f"{folder}/out")
    return out.select("company", "revenue", "gross_profit", "operating_income", "net_income", "gross_margin", "operating_margin", "net_margin")
