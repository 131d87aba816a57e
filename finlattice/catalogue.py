"""All queries of the library by name, over the driver's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text as X
from .operators import accounts, matching, memory, review, statements, telemetry, validation
from .plans import providers, workflow
from .streaming import events as event_windows_

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


_SUMS = """select n_name as company, sum(l_extendedprice::decimal(12,2) * (1 - l_discount::decimal(4,2)))::decimal(24,2) as r, sum(l_quantity::decimal(12,2) * p_retailprice::decimal(12,2))::decimal(24,2) as c, sum(l_extendedprice::decimal(12,2) * l_tax::decimal(4,2))::decimal(24,2) as x
 from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join part on l_partkey = p_partkey group by n_name"""
_PEERS = f"""with s as ({_SUMS}), v as (select company, r::double as revenue, (r - c)::double as gross_profit, (r - c - x)::double as operating_income, (r - c - 2 * x)::double as net_income from s)
select *, case when revenue <> 0 and gross_profit <> 0 then round(gross_profit / revenue * 100, 1) end as gross_margin, case when revenue <> 0 then round(operating_income / revenue * 100, 1) end as operating_margin, case when revenue <> 0 then round(net_income / revenue * 100, 1) end as net_margin from v"""


def _peer_cells(spark, sf):
    """Income statements of nations, figures written as text."""
    l, o, c, n, p = (t(spark, sf, x) for x in ("lineitem", "orders", "customer", "nation", "part"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(p, l.l_partkey == p.p_partkey)
    d = lambda col, k: F.col(col).cast(f"decimal({k},2)")
    s = j.groupBy(F.col("n_name").alias("company")).agg(F.sum(d("l_extendedprice", 12) * (1 - d("l_discount", 4))).cast("decimal(24,2)").alias("r"), F.sum(d("l_quantity", 12) * d("p_retailprice", 12)).cast("decimal(24,2)").alias("c"), F.sum(d("l_extendedprice", 12) * d("l_tax", 4)).cast("decimal(24,2)").alias("x"))
    write = lambda e: F.when(F.expr(e) < 0, F.concat(F.lit("("), F.format_number(-F.expr(e), 2), F.lit(")"))).otherwise(F.concat(F.lit("$"), F.format_number(F.expr(e), 2)))
    rows = F.array(*(F.struct(F.lit(i).alias("row_pos"), F.lit(a).alias("label"), write(e).alias("value_raw")) for i, (a, e) in enumerate([("Total revenue", "r"), ("Cost of sales", "c"), ("Gross profit", "r - c"), ("Operating income", "r - c - x"), ("Net income", "r - c - 2 * x")])))
    return s.select("company", F.lit(0).alias("section_pos"), F.explode(rows).alias("q")).select("company", "section_pos", "q.*")


@query(_PEERS)
def peer_comparison(spark, sf):
    m = statements.metric_values(_peer_cells(spark, sf), "company")
    return statements.ratios(m.groupBy("company").pivot("metric", ["revenue", "gross_profit", "operating_income", "net_income"]).agg(F.first("value")))


@query(f"""with s as ({_SUMS}), v as (select company, r::double as revenue, (r - c)::double as gross_profit from s)
select 'revenue' as metric, max(case when company = 'NATION_0' then revenue end) as a, count(revenue) as companies from v union all select 'gross_profit', max(case when company = 'NATION_0' then gross_profit end), count(gross_profit) from v""")
def peer_pivot(spark, sf):
    m = statements.metric_values(_peer_cells(spark, sf), "company").where("metric in ('revenue', 'gross_profit')")
    return m.groupBy("metric").agg(F.max(F.when(F.col("company") == "NATION_0", F.col("value"))).alias("a"), F.count("value").alias("companies"))


@query("select c_custkey, case c_custkey % 6 when 0 then -abs(c_acctbal) when 1 then abs(c_acctbal) when 2 then null when 3 then abs(c_acctbal) when 4 then null else c_acctbal end as value from customer")
def parse_value(spark, sf):
    c = t(spark, sf, "customer").withColumn("k", F.col("c_custkey") % 6)
    a, b = F.format_number(F.abs("c_acctbal"), 2), F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    raw = F.when(F.col("k") == 0, F.concat(F.lit("("), a, F.lit(")"))).when(F.col("k") == 1, F.concat(F.lit(" $"), a)).when(F.col("k") == 2, F.lit("N/A")).when(F.col("k") == 3, F.concat(a, F.lit("%"))).when(F.col("k") == 4, F.concat(F.lit("$("), a, F.lit(")"))).otherwise(b)
    return c.select("c_custkey", X.parse_value(raw).alias("value"))


_LABEL = "p_name || case p_partkey % 4 when 0 then ' Supplies / Vaccinations' when 1 then ' and Consultations Revenue' when 2 then ' Payments & Diagnostics' else ' Boarding' end"


def _labels(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.expr(_LABEL).alias("label"))


@query(f"with l as (select p_partkey, {_LABEL} as label from part) select p_partkey, array_to_string(list_sort({X.duck_tokens('label')}), ' ') as tokens from l")
def tokenize_labels(spark, sf):
    return _labels(spark, sf).select("p_partkey", F.array_join(F.array_sort(X.tokenize(F.col("label"))), " ").alias("tokens"))


@query(f"""with l as (select p_partkey, {_LABEL} as label, ['Total Revenue', 'Gross Profit', 'EI Expense', ' revenue ', 'Operating Expenses'][1 + p_partkey % 5] as head from part)
select p_partkey, contains(label, '/') or contains(label, ' & ') or contains(label, ' and ') or contains(label, ' + ') as compound, p_partkey % 5 <> 2 as header,
 array_to_string(list_filter(list_transform(regexp_split_to_array(label, '\\s*[/&]\\s*|\\s+and\\s+'), lambda x: trim(x)), lambda x: x <> ''), '|') as parts from l""")
def label_predicates(spark, sf):
    head = F.expr("element_at(array('Total Revenue', 'Gross Profit', 'EI Expense', ' revenue ', 'Operating Expenses'), cast(1 + p_partkey % 5 as int))")
    return _labels(spark, sf).select("p_partkey", X.is_compound(F.col("label")).alias("compound"), X.is_section_header(head).alias("header"), F.array_join(X.compound_parts(F.col("label")), "|").alias("parts"))


_ACCOUNTS = "select distinct split_part(p_name, ' ', 1) || ' goods' as name from part"


@query(f"""with a as (select name, row_number() over (order by name) as pos from ({_ACCOUNTS})), l as (select distinct p_name as label from part),
m as (select label, name, pos, case when label = name then 1 when len(label) > 4 and contains(name, label) then 2 when len(name) > 4 and contains(label, name) then 3 else 4 end as layer,
  len(list_filter(lt, lambda p: len(list_filter(nt, lambda c: p = c or (len(p) >= 5 and len(c) >= 5 and (starts_with(p, c) or starts_with(c, p))))) > 0)) / len(lt) as ratio
  from (select label, {X.duck_tokens('label')} as lt from l) , (select name, pos, {X.duck_tokens('name')} as nt from a)),
h as (select *, count(*) filter (ratio > 0) over (partition by label) as n, row_number() over (partition by label order by (layer = 4)::int, case when layer < 4 then 0 else -ratio end, pos) as rn from m where layer < 4 or ratio > 0)
select l.label, pos as code, case when layer is null then 'unmatched' when layer <= 2 then 'high' when layer = 3 then 'medium' when ratio = 1 then (case when n = 1 then 'high' else 'ambiguous' end) else 'medium' end as confidence,
 case when layer is null then 'unmatched' when layer = 1 then 'exact' when layer < 4 then 'exact_substring' when ratio = 1 then 'token' else 'token_partial' end as match_type, case when layer = 4 then round(ratio, 6) end as match_ratio
 from l left join h on h.label = l.label and rn = 1""")
def match_accounts(spark, sf):
    p = t(spark, sf, "part")
    a = p.select(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" goods")).alias("name")).distinct().withColumn("pos", F.row_number().over(Window.orderBy("name")).cast("long"))
    return matching.match(p.select(F.col("p_name").alias("label")), a.withColumn("code", F.col("pos"))).select("label", "code", "confidence", "match_type", "match_ratio")


@query("select l_orderkey, round(avg(case when l_quantity < 5 or l_linenumber = 3 then 1 else 0 end), 6) as missing_ratio from lineitem group by l_orderkey")
def missing_ratio(spark, sf):
    raw = F.when(F.col("l_quantity") < 5, F.lit(None)).when(F.col("l_linenumber") == 3, F.lit("null")).otherwise(F.col("l_quantity").cast("string"))
    return statements.missing_ratio(t(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("row_pos"), raw.alias("value_raw")), "l_orderkey")


@query("""with s as (select l_orderkey, sum(l_extendedprice::decimal(12,2)) as v from lineitem group by 1)
select o_orderkey, o_totalprice as assets, round(abs(o_totalprice - (v::double * 0.5 + v::double * 0.5)), 2) as difference, not (abs(o_totalprice - (v::double * 0.5 + v::double * 0.5)) > greatest(abs(o_totalprice) * 0.01, 1000.0)) as balanced from orders join s on l_orderkey = o_orderkey""")
def balance_check(spark, sf):
    s = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("double").alias("v"))
    o = t(spark, sf, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("o_totalprice").alias("assets"), (F.col("v") * 0.5).alias("liabilities"), (F.col("v") * 0.5).alias("equity"))
    return statements.balance_check(o).select("o_orderkey", "assets", F.round("difference", 2).alias("difference"), "balanced")


@query("""select doc_id, section, period, total from (select l_orderkey as doc_id, l_returnflag as section, l_linestatus as period, l_extendedprice as total, row_number() over (partition by l_orderkey, l_returnflag, l_linestatus order by l_linenumber desc, l_extendedprice desc) as rn from lineitem) where rn = 1""")
def section_totals(spark, sf):
    l = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("section"), F.col("l_linestatus").alias("period"), F.col("l_linenumber").alias("row_pos"), F.lit("Total").alias("label"), F.lit(False).alias("is_subtotal"), F.col("l_extendedprice").alias("value_num"))
    return statements.section_totals(l)


@query("""with m as (select l_orderkey as doc_id, l_returnflag as section, min(l_linenumber) as fp, string_agg(l_partkey::varchar, '|' order by l_linenumber, l_partkey, l_partkey::varchar) as labels, count(*)::int as n_rows from lineitem group by 1, 2)
select doc_id, (row_number() over (partition by doc_id order by fp, section))::int as section_no, section, labels, n_rows from m""")
def merge_pages(spark, sf):
    l = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("section"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("row_pos"), F.col("l_partkey").cast("string").alias("label"))
    return statements.merge_pages(l)


@query("""with r as (select o_custkey, o_orderkey, o_orderpriority, 2 + row_number() over (partition by o_custkey order by o_orderkey) as row_no from orders)
select o_custkey, row_no::int as row_no, 1 as col_no, o_orderkey::varchar as value from r union all select o_custkey, row_no::int, 2, o_orderpriority from r
union all select distinct o_custkey, 2, 1, 'o_orderkey' from orders union all select distinct o_custkey, 2, 2, 'o_orderpriority' from orders""")
def sheet_cells(spark, sf):
    return statements.sheet_cells(t(spark, sf, "orders"), "o_custkey", ["o_orderkey"], ["o_orderkey", "o_orderpriority"])


def _rules(spark, sf, where):
    e = t(spark, sf, "events").where(where)
    return e.select(F.concat(F.lit("u"), F.col("user_id")).alias("label"), F.col("event_type").alias("section"), F.concat(F.lit("w"), F.col("event_id") % 3).alias("wrong_code"), F.concat(F.lit("c"), F.col("event_id") % 5).alias("correct_code"), F.col("event_id").alias("seq"))


@query("""with d as (select 'u' || user_id as k, event_type as s, 'c' || event_id % 5 as c, event_id as seq, (value >= 10)::int as p from events)
select k as label_key, s as section_key, arg_max(c, p * 1000000000 + seq) as correct_code from d group by 1, 2""")
def corrections_override(spark, sf):
    pick = lambda w: _rules(spark, sf, w).select("label", "section", "correct_code", "seq")
    return memory.override(pick("value < 10"), pick("value >= 10"))


@query("""with e as (select 'u' || user_id as label, event_type as section, 'w' || event_id % 3 as w, 'c' || event_id % 5 as c, event_id as seq, value from events),
old as (select label, section, arg_min(w, seq) as wrong_code, arg_max(c, seq) as correct_code, count(*) as count from e where value < 10 group by 1, 2), nw as (select label, section, arg_min(w, seq) as w, arg_max(c, seq) as c, count(*) as n from e where value >= 10 group by 1, 2)
select label, section, coalesce(wrong_code, w) as wrong_code, coalesce(c, correct_code) as correct_code, coalesce(count, 0) + coalesce(n, 0) as count, count is null as inserted from old full join nw using (label, section)""")
def corrections_upsert(spark, sf):
    old = _rules(spark, sf, "value < 10").groupBy("label", "section").agg(F.min_by("wrong_code", "seq").alias("wrong_code"), F.max_by("correct_code", "seq").alias("correct_code"), F.count("*").alias("count"))
    return memory.upsert(old, _rules(spark, sf, "value >= 10"))


@query("""select event_type as label, 's' as section, 'c' || event_id % 50 as correct_code, count(distinct user_id) as practices, count(*) as total from events group by 1, 2, 3 having count(distinct user_id) >= 3 and count(*) >= 3""")
def corrections_promoted(spark, sf):
    e = t(spark, sf, "events").select(F.col("event_type").alias("label"), F.lit("s").alias("section"), F.concat(F.lit("c"), F.col("event_id") % 50).alias("correct_code"), F.col("user_id").alias("practice_id"), F.lit(1).cast("long").alias("count"))
    return memory.promotable(e)


@query("""select event_id as row_id, event_type as label, 'w' || event_id % 4 as code, 'c' as correct_code, r.n >= 2 as hard_fail from events join (values ('click', 'w1', 1), ('view', 'w2', 3), ('error', 'c', 5)) r(k, w, n) on event_type = k and 'w' || event_id % 4 = w where w <> 'c'""")
def corrections_ignored(spark, sf):
    rules = spark.createDataFrame([("Click", "w1", "c", 1), ("View", "w2", "c", 3), ("Error", "c", "c", 5)], "label string, wrong_code string, correct_code string, count int")
    e = t(spark, sf, "events").select(F.col("event_id").alias("row_id"), F.col("event_type").alias("label"), F.concat(F.lit("w"), F.col("event_id") % 4).alias("code"))
    return memory.ignored(e, F.broadcast(rules))


@query("""with a as (select event_id, user_id, '2024-' || lpad((1 + user_id % 12)::varchar, 2, '0') as month, user_id % 5 = 0 as pro, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type = 'purchase')
select event_id, user_id, month, pro or n <= 2 as allowed, (case when pro then n else least(n, 2) end)::int as used, (case when pro then null else greatest(0, 2 - n) end)::int as remaining from a""")
def monthly_quota(spark, sf):
    e = t(spark, sf, "events").where("event_type = 'purchase'")
    return telemetry.quota(e.select("event_id", "user_id", "ts", F.concat(F.lit("2024-"), F.lpad((1 + F.col("user_id") % 12).cast("string"), 2, "0")).alias("month"), (F.col("user_id") % 5 == 0).alias("pro")))


@query("""select count(*) as total_runs, round(count(*) filter (event_type <> 'error') * 100 / count(*), 1) as success_rate, round(avg(value), 2) as avg_seconds, sum(event_id % 7)::bigint as calls from events where ts > (select max(ts) from events) - interval 7 days""")
def run_stats(spark, sf):
    e = t(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))
    runs = e.join(F.broadcast(now)).select("ts", "now", (F.col("event_type") != "error").alias("success"), F.col("value").alias("seconds"), (F.col("event_id") % 7).alias("calls"))  # one row
    return telemetry.run_stats(runs, F.col("now"))


@query("select event_id as run_id, ts, event_type from events order by ts desc, event_id desc limit 10")
def recent_runs(spark, sf):
    return telemetry.recent(t(spark, sf, "events").select(F.col("event_id").alias("run_id"), "ts", "event_type"))


@query("select user_id as run_id, count(*) as calls, round(sum(round(event_id % 5000 / 1000, 3)), 3) as seconds, arg_max(event_id % 5000, event_id) as last_ms from events group by 1")
def call_counters(spark, sf):
    return telemetry.call_counters(t(spark, sf, "events").select(F.col("user_id").alias("run_id"), (F.col("event_id") % 5000).alias("ms"), F.lit(0).alias("ts"), "event_id"))


@query("""with r as (select user_id, event_type = 'error' as header, case when event_type <> 'signup' then event_type end as code, case when event_type in ('click', 'purchase') then 'high' else 'low' end as confidence, value < 5 as needs_review from events),
g as (select user_id, count(*) as total, count(*) filter (not header) as postable, count(*) filter (code is not null and not header) as mapped, count(*) filter (confidence = 'high' and code is not null and not header) as high, count(*) filter (needs_review) as review from r group by 1),
s as (select *, round(coalesce(mapped / nullif(postable, 0), 0), 3) as coverage, round(coalesce(high / nullif(mapped, 0), 0), 3) as high_share, round(coalesce(review / nullif(total, 0), 0), 3) as review_rate from g)
select *, (case when coverage >= 0.9 then 10 when coverage >= 0.7 then 7 when coverage >= 0.5 then 5 else 0 end)::int as coverage_points, coverage >= 0.7 as passed from s""")
def quality_counters(spark, sf):
    e = t(spark, sf, "events").select("user_id", (F.col("event_type") == "error").alias("header"), F.when(F.col("event_type") != "signup", F.col("event_type")).alias("code"), F.when(F.col("event_type").isin("click", "purchase"), "high").otherwise("low").alias("confidence"), (F.col("value") < 5).alias("needs_review"))
    return telemetry.quality_counters(e, "user_id")


@query("select event_id, props as body, json_extract_string(props, '$.k')::bigint as k from events")
def model_answers(spark, sf):
    e = t(spark, sf, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("<think>a\n{b}</think>\n```json\n"), F.col("props"), F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```"), F.col("props"), F.lit("```"))).otherwise(F.concat(F.lit("  "), F.col("props")))
    body = X.first_object(X.model_text(raw))
    return e.select("event_id", body.alias("body"), F.get_json_object(body, "$.k").cast("long").alias("k"))


@query("select doc_id, len(text) > 100 as has_text_layer, substr(text, 1, 500) as preview from documents")
def text_layer(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", (F.length("text") > 100).alias("has_text_layer"), F.substring("text", 1, 500).alias("preview"))


@query("""select p_partkey, (5000 + p_partkey % 5000)::varchar as code, substr((5000 + p_partkey % 5000)::varchar, 1, 2) || '00' as series, case substr((5000 + p_partkey % 5000)::varchar, 1, 2) when '50' then 'Revenue' when '60' then 'Direct Cost' when '70' then 'Operating Expense' when '80' then 'Other Expense' when '90' then 'Other' else 'Unknown' end as category from part""")
def account_series(spark, sf):
    code = (5000 + F.col("p_partkey") % 5000).cast("string")
    return t(spark, sf, "part").select("p_partkey", code.alias("code"), X.series_of(code).alias("series"), X.category_of(code).alias("category"))


@query("""with n as (select user_id as label, arg_max('c' || event_id % 9, event_id) as c from events where event_type = 'click' group by 1)
select event_id, user_id as label, case when value < 10 and c is not null then c else event_type end as code, case when value < 10 and c is not null then 'llm_retry' else 'llm' end as match_type from events left join n on user_id = label where event_type <> 'click'""")
def retry_merge(spark, sf):
    e = t(spark, sf, "events")
    rows = e.where("event_type <> 'click'").select("event_id", F.col("user_id").alias("label"), F.col("event_type").alias("code"), F.lit("llm").alias("match_type"), (F.col("value") < 10).alias("needs_review"))
    new = e.where("event_type = 'click'").select(F.col("user_id").alias("label"), F.concat(F.lit("c"), F.col("event_id") % 9).alias("code"), F.col("event_id").alias("seq"))
    return matching.retry_merge(rows, new).drop("needs_review")


@query("select date_trunc('hour', ts) as window_start, event_type as kind, count(*) as events, sum(event_id % 5000)::bigint as total_ms from events group by 1, 2")
def event_windows(spark, sf):
    return event_windows_.windowed(t(spark, sf, "events").withColumn("ms", F.col("event_id") % 5000), "ts", "event_type", "ms")


_INCOME = "select o_orderkey, case when o_orderkey % 11 <> 0 then o_totalprice end as revenue, o_totalprice * 0.5 as cost, o_totalprice * (0.4 + (o_orderkey % 5) * 0.05) as gross_profit, o_totalprice * ((o_orderkey % 7) * 0.5 - 1.6) as net_income from orders"


@query(f"""select *, coalesce(abs(gross_profit - (revenue - cost)) > greatest(abs(revenue) * 0.05, 10000.0), false) as gross_gap, coalesce(revenue > 0 and abs(net_income) > revenue, false) as odd_margin
 from ({_INCOME.replace('0.05)', '0.05::double)').replace('0.5 - 1.6', '0.5::double - 1.6::double').replace('* 0.5 as', '* 0.5::double as').replace('(0.4 ', '(0.4::double ')})""")
def income_check(spark, sf):
    o, d = t(spark, sf, "orders"), lambda x: F.lit(float(x))
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    rows = o.select("o_orderkey", F.when(k % 11 != 0, p).alias("revenue"), (p * d(0.5)).alias("cost"), (p * (d(0.4) + (k % 5) * d(0.05))).alias("gross_profit"), (p * ((k % 7) * d(0.5) - d(1.6))).alias("net_income"))
    return statements.income_check(rows)


@query("""select doc_id, case doc_id % 3 when 2 then '' else array_to_string(list_filter([0, doc_id % 9, 3, n_chars // 100], lambda x: x between 1 and 1 + doc_id % 6), ',') end as pages from documents""")
def page_map(spark, sf):
    d = t(spark, sf, "documents")
    listed = F.format_string('[0, %s, 3, true, "2", 2.5, %s]', F.col("doc_id") % 9, F.floor(F.col("n_chars") / 100))
    answer = F.when(F.col("doc_id") % 3 == 0, listed).when(F.col("doc_id") % 3 == 1, listed).when(F.col("doc_id") % 2 == 0, '{"a": 1}').otherwise("no JSON [")
    out = statements.valid_pages(d.select("doc_id", answer.alias("answer"), (1 + F.col("doc_id") % 6).alias("total_pages")))
    return out.select("doc_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query("""select o_custkey, string_agg('- "' || o_orderstatus || '" in "' || o_orderpriority || '" → ' || o_orderkey % 10 || ' n (' || case when o_orderkey % 3 >= 2 then 'NEVER ' else 'previously mis-mapped to ' end || o_orderkey % 7 || ')', chr(10) order by o_orderkey) as prompt from orders group by 1""")
def correction_prompt(spark, sf):
    k = F.col("o_orderkey")
    rules = t(spark, sf, "orders").select("o_custkey", F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("section"), (k % 7).cast("string").alias("wrong_code"), (k % 10).cast("string").alias("correct_code"), F.lit("n").alias("correct_name"), (k % 3).alias("count"), k.alias("seq"))
    return memory.prompt_lines(rules, "o_custkey")


_CHART = "select (5000 + p_partkey % 5000)::varchar as code, arg_max(p_name, p_partkey) as name, min(p_partkey) as pos from part group by 1"


def _chart(spark, sf):
    p = t(spark, sf, "part").select((5000 + F.col("p_partkey") % 5000).cast("string").alias("code"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("description"), F.col("p_partkey").alias("pos"))
    return accounts.latest(p)


@query(f"select code, name, pos from ({_CHART})")
def accounts_latest(spark, sf):
    return _chart(spark, sf).select("code", "name", "pos")


@query(f"select code, code || ' - ' || name as shown from ({_CHART}) where contains(lower(code || ' - ' || name), 'ring') order by pos limit 20")
def account_lookup(spark, sf):
    return accounts.lookup(_chart(spark, sf), "RING")


@query(f"""with c as ({_CHART}), h(d, t) as (values ('5', 'Revenue (accounts 5000 to 5999)'), ('6', 'Direct costs (accounts 6000 to 6999)'), ('7', 'Operating expenses (accounts 7000 to 7999)'), ('8', 'Depreciation and other expenses (accounts 8000 to 8999)'), ('9', 'Interest, taxes and other items (accounts 9000 to 9999)')),
b as (select d, t || coalesce(chr(10) || string_agg(code || ' - ' || name, chr(10) order by code), '') as x from h left join c on starts_with(code, d) group by d, t)
select string_agg(x, chr(10) || chr(10) order by d) as text from b""")
def chart_text(spark, sf):
    return accounts.chart_text(_chart(spark, sf))


@query("""with n as (select p_partkey, p_name || case p_partkey % 3 when 0 then ' Services' when 1 then '/Tick, Cost' else ' & other' end as name from part),
w as (select p_partkey, unnest(list_filter(string_split(trim(replace(replace(replace(name, ',', ''), '&', ''), '/', ' ')), ' '), lambda x: len(x) > 2 and lower(x) not in ('services', 'cost', 'other', 'the', 'and'))) as a from n
 union select p_partkey, name from n union select p_partkey, trim(unnest(string_split(name, '/'))) from n where contains(name, '/'))
select p_partkey, string_agg(a, '|' order by a) as aliases from w group by 1""")
def account_aliases(spark, sf):
    tail = F.when(F.col("p_partkey") % 3 == 0, " Services").when(F.col("p_partkey") % 3 == 1, "/Tick, Cost").otherwise(" & other")
    return t(spark, sf, "part").select("p_partkey", F.array_join(accounts.aliases(F.concat("p_name", tail)), "|").alias("aliases"))


@query("""select p_partkey, case p_partkey % 6 when 0 then '5' when 1 then '6' when 2 then '5' when 3 then '7' else '5,6,7,8,9' end as allowed, p_partkey % 6 in (0, 2, 4, 5) as may_hold_5 from part""")
def section_series(spark, sf):
    name = F.element_at(F.array(*map(F.lit, [" Revenue ", "cost of goods sold", "Cost of sales", "Payroll", "Taxes", ""])), (F.col("p_partkey") % 6 + 1).cast("int"))
    allowed = accounts.allowed_series(name)
    return t(spark, sf, "part").select("p_partkey", F.array_join(allowed, ",").alias("allowed"), F.array_contains(allowed, "5").alias("may_hold_5"))


_ROLE = "case l_returnflag when 'A' then 'Assets' when 'N' then 'Liabilities' else 'Equity' end"


def _balance_cells(spark, sf):
    """Orders as balance sheets: a section per line and flag, a total row per item; line status names the period."""
    return t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit("balance_sheet").alias("statement_type"), F.expr(_ROLE).alias("section_name"), F.col("l_linenumber").alias("section_pos"), F.struct("l_partkey", "l_extendedprice").alias("row_pos"),
        F.when(F.col("l_linenumber") % 3 == 0, "Accumulated loss").otherwise("Total").alias("label"), F.lit(True).alias("is_subtotal"), (F.col("l_linestatus") == "O").cast("int").alias("period_pos"), (F.col("l_extendedprice") - F.col("l_tax") * 200000).alias("value_num"))


_BALANCE = f"""with c as (select l_orderkey as doc_id, {_ROLE} as s, l_linenumber as sp, (l_linestatus = 'O')::int as period_pos, arg_max(l_extendedprice - l_tax * 200000::double, (l_partkey, l_extendedprice)) as v from lineitem group by 1, 2, 3, 4),
e as (select *, max(sp) over (partition by doc_id, s) as top from c),
b as (select doc_id, period_pos, max(v) filter (s = 'Assets') as assets, max(v) filter (s = 'Liabilities') as liabilities, max(v) filter (s = 'Equity') as equity from e where sp = top group by 1, 2)"""


@query(f"{_BALANCE} select * from b")
def role_totals(spark, sf):
    return validation.role_totals(_balance_cells(spark, sf))


@query(f"""{_BALANCE} select 'unbalanced' as "check", 'error' as level, count(*) as n from b where abs(assets - (liabilities + equity)) > greatest(abs(assets) * 0.01::double, 1000.0)
 union all select 'negative_asset', 'warning', count(*) from lineitem where l_returnflag = 'A' and l_linenumber % 3 <> 0 and l_extendedprice - l_tax * 200000::double < 0""")
def validation_findings(spark, sf):
    return validation.findings(_balance_cells(spark, sf)).groupBy("check", "level").agg(F.count("*").alias("n"))


@query("""with k as (select l_orderkey, unnest(['ASSET', 'LIABILIT', 'EQUITY', 'OPERATING', 'INVESTING', 'FINANCING']) as w, unnest(['A', 'N', 'R', '', '', '']) as f, unnest([1, 2, 3, 4, 5, 6]) as i from (select distinct l_orderkey from lineitem)),
m as (select * from k where (case when l_orderkey % 3 = 0 then i <= 3 when l_orderkey % 3 = 1 then i > 3 else false end) and not exists (from lineitem l where l.l_orderkey = k.l_orderkey and l_returnflag = f))
select d.l_orderkey as doc_id, coalesce(string_agg(w, ',' order by i), '') as missing from (select distinct l_orderkey from lineitem) d left join m on m.l_orderkey = d.l_orderkey group by 1""")
def missing_sections(spark, sf):
    l = t(spark, sf, "lineitem")
    kind = F.expr("case l_orderkey % 3 when 0 then 'balance_sheet' when 1 then 'cash_flow' else 'none' end")
    s = l.groupBy(F.col("l_orderkey").alias("doc_id"), kind.alias("statement_type")).agg(F.collect_list(F.struct(F.expr(_ROLE).alias("name"))).alias("sections"))
    return validation.missing_sections(s).select("doc_id", F.array_join("missing", ",").alias("missing"))


@query("""select event_id, case event_id % 4 when 0 then 'Missing required key: title|Missing required key: periods|Missing required key: sections' when 1 then 'Section 0 missing ''rows'' field' when 2 then 'Periods must be a non-empty list|Sections must be a non-empty list' else '' end as errors from events""")
def structure_errors(spark, sf):
    text = F.expr("""case event_id % 4 when 0 then props when 1 then '{"title": 1, "periods": [1], "sections": [{"name": 1}]}' when 2 then '{"title": 1, "periods": 1, "sections": []}' else '{"title": 1, "periods": [1], "sections": [{"name": 1, "rows": [{"label": 1, "values": 2}]}]}' end""")
    e = t(spark, sf, "events").select(F.col("event_id").alias("doc_id"), text.alias("text"))
    return validation.structure_errors(e).select(F.col("doc_id").alias("event_id"), F.array_join("errors", "|").alias("errors"))


@query("""with p as (select l_orderkey as doc_id, l_linestatus as p, min(l_linenumber) as n from lineitem group by 1, 2), s as (select l_orderkey as doc_id, l_returnflag as s, min(l_linenumber) as n from lineitem group by 1, 2)
select doc_id, (select string_agg(s.s, ',' order by n, s.s) from s where s.doc_id = d.doc_id) as sections, (select string_agg(p.p, ',' order by n, p.p) from p where p.doc_id = d.doc_id) as periods, n_rows from (select l_orderkey as doc_id, count(*)::int as n_rows from lineitem group by 1) d""")
def merge_statement_pages(spark, sf):
    """Lines as pages of a statement: flags are sections, line status the period."""
    row = F.struct(F.col("l_partkey").cast("string").alias("label"), F.array(F.lit("1")).alias("values"), F.lit(False).alias("is_subtotal"))
    s = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_pos"), F.col("l_returnflag").alias("name")).agg(F.collect_list(row).alias("rows"), F.sort_array(F.collect_set("l_linestatus")).alias("p"))
    pages = s.groupBy("doc_id", "page_pos").agg(F.array_sort(F.collect_list(F.struct("name", "rows"))).alias("sections"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))).alias("periods"))
    m = statements.merge_statements(pages.withColumns({"statement_type": F.lit("x"), "title": F.lit("t")}))
    return m.select("doc_id", F.array_join("sections.name", ",").alias("sections"), F.array_join("periods", ",").alias("periods"), F.size(F.flatten("sections.rows")).alias("n_rows"))


@query("select n_regionkey::varchar as metric, string_agg(n_name || '=' || n_nationkey, ',' order by n_name) as by_company from nation group by 1")
def metric_maps(spark, sf):
    v = t(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("metric"), F.col("n_name").alias("company"), F.col("n_nationkey").alias("value"))
    shown = F.array_join(F.transform(F.map_entries("by_company"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return statements.metric_maps(v).select("metric", shown.alias("by_company"))


def _event_rows(spark, sf):
    """Events as rows of their users' statements, with answers for some labels (c6 doubtful, c5 split)."""
    e = t(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.lit(0).alias("section_pos"), F.col("event_type").alias("section"), F.col("event_id").alias("row_pos"), F.when(F.col("event_type") == "error", "Total Revenue").otherwise(F.concat(F.lit("c"), F.col("event_id") % 8)).alias("label"), (F.col("event_id") % 11 == 0).alias("is_subtotal"))
    a = e.sparkSession.createDataFrame([(f"c{i}", s, None if i == 3 else f"a{i + s}", "n", "k", "low" if i == 6 else "high", "r", False, i == 5) for i in (1, 2, 3, 4, 5, 6) for s in (0, 1)], "label string, seq int, " + workflow.RECORD.split(", ", 1)[1])
    return review.categorise(e, a)


_ROWS = """with r as (select user_id as doc_id, event_id, event_type, event_id % 8 as k, event_id % 11 = 0 as sub, event_type = 'error' as head from events),
c as (select *, case when not sub and not head and k in (1, 2, 4, 5, 6) then 'a' || k + 1 end as code, case when sub then null when head then 'section_header' when k = 5 then 'llm_split' when k in (1, 2, 4, 6) then 'llm' else 'unmatched' end as match_type, case when sub then null else not head and k in (0, 3, 6, 7) end as needs_review from r)"""


@query(f"{_ROWS} select doc_id, event_id as row_pos, code as coa_code, match_type, needs_review from c")
def categorised_rows(spark, sf):
    return _event_rows(spark, sf).select("doc_id", "row_pos", "coa_code", "match_type", "needs_review")


@query(f"{_ROWS}, g as (select doc_id, count(*) as total, count(*) filter (head) as headers, count(code) as mapped, count(*) filter (needs_review) as review from c where match_type is not null group by 1) select *, round(coalesce(mapped / nullif(total - headers, 0), 0), 3) as match_rate from g")
def category_summary(spark, sf):
    return review.summary(_event_rows(spark, sf))


@query(f"{_ROWS}, s as (select doc_id, event_id, case when code is not null then 'mapped' when not sub and head then 'section_header' else 'uncategorized' end as status, row_number() over (partition by doc_id order by event_id) as place from c where not sub) select doc_id, place::int as place, status from s where place <= 5")
def category_samples(spark, sf):
    return review.samples(_event_rows(spark, sf), 5).select("doc_id", "place", "status")


@query(f"{_ROWS} select doc_id, event_id as row_pos, match_type from c where needs_review")
def review_queue(spark, sf):
    return review.queue(_event_rows(spark, sf)).select("doc_id", "row_pos", "match_type")


@query(f"""{_ROWS} select doc_id, event_id as row_pos, case when needs_review and k in (0, 6) and not head then 'new' else code end as coa_code, case when needs_review and k in (0, 6) and not head then 'llm_retry' else match_type end as match_type from c""")
def retried_rows(spark, sf):
    rows = _event_rows(spark, sf)
    new = spark.createDataFrame([(x, 1, "new", "n", "k", "high", "r", False, False) for x in ("c0", "c1", "c6")], "label string, seq int, " + workflow.RECORD.split(", ", 1)[1])
    return review.merge_retry(rows, new).select("doc_id", "row_pos", "coa_code", "match_type")


@query(f"""{_ROWS} select doc_id, 'c' || k as label, coalesce(code, 'None') as wrong_code, '5001' as correct_code, '' as correct_name, event_id as row from c where needs_review and event_id % 2 = 0""")
def review_corrections(spark, sf):
    q = review.queue(_event_rows(spark, sf))
    chosen = q.where("row_pos % 2 = 0").select("doc_id", "section_pos", "row_pos", F.lit("5001").alias("new_code"))
    named = review.corrections(q.withColumn("section", F.col("row_pos").cast("string")), chosen, _chart(spark, sf).where("code < '5000'"))
    return named.select("doc_id", "label", "wrong_code", "correct_code", "correct_name", F.col("section").cast("long").alias("row"))


@query(f"{_ROWS} select doc_id, case when head then 'Total Revenue' else 'c' || k end as label, arg_min(event_type, event_id) as section from c group by 1, 2")
def first_sections(spark, sf):
    return review.first_sections(_event_rows(spark, sf))


@query(f"{_ROWS} select r.doc_id, event_id as row_pos from c r where not head and exists (from c q where q.doc_id = r.doc_id and q.needs_review and q.k = r.k) ")
def retry_items(spark, sf):
    rows = _event_rows(spark, sf)
    return review.retry_items(rows.where("label <> 'Total Revenue'"), rows).select("doc_id", "row_pos")


@query("""select conv_id as doc_id, count(*) as total_pages, coalesce(sum(len(text)), 0) > 100 as has_text from conversations group by 1""")
def page_text_layer(spark, sf):
    return workflow.has_text(t(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_num"), "text"))


@query("""select conv_id as doc_id, string_agg('Page ' || turn || ':' || chr(10) || case when coalesce(text, '') = '' then '[No text extracted]' else substr(text, 1, 500) end, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by turn, text) as preview from conversations group by 1""")
def page_previews(spark, sf):
    return workflow.previews(t(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_num"), "text"))


def _lengths(prompts, images):
    """A stand-in for a model: it fails for a batch with an empty prompt."""
    if "" in prompts:
        raise ValueError("empty prompt")
    return [str(len(p)) for p in prompts]


@query("select conv_id, turn, case when text <> '' then len(text)::varchar end as answer, text = '' as failed from conversations where text is not null")
def model_calls(spark, sf):
    c = t(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    return providers.answers(c, _lengths, batch=1).select("conv_id", "turn", "answer", F.col("error").isNotNull().alias("failed"))


@query("""with s as (select doc_id, quality, toxic, ((case when quality = 1 then 10 else 6 end) + (case when toxic = 1 then 9 else 10 end) + 4) / 3 as average from labels)
select doc_id, round(average, 6) as average, quality = 1 and toxic = 0 and average >= 7 as passed from s""")
def judge_scores(spark, sf):
    s = F.create_map(F.lit("completeness"), F.when(F.col("quality") == 1, 10.0).otherwise(6.0), F.lit("format"), F.when(F.col("toxic") == 1, 9.0).otherwise(10.0), F.lit("other"), F.lit(4.0))
    return t(spark, sf, "labels").select("doc_id", F.round(validation.average_score(s), 6).alias("average"), F.coalesce(validation.extraction_passed(s), F.lit(False)).alias("passed"))


@query("select d.user_id as doc_id, coalesce(bool_and(event_type <> 'error'), false) as passed from (select distinct user_id from events) d left join events e on e.user_id = d.user_id and value >= 50 group by 1")
def all_passed(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_type") != "error").alias("passed"), "value")
    return validation.all_passed(e.where("value >= 50"), e)


@query("with l as (select user_id, event_type, arg_max(event_id % 5000, (ts, event_id)) as v from events group by 1, 2) select user_id, string_agg(event_type || '=' || v, ',' order by event_type) as by_name from l group by 1")
def node_timings(spark, sf):
    e = t(spark, sf, "events").withColumn("ms", F.col("event_id") % 5000)
    m = telemetry.last_values(e, "user_id", "event_type", "ms")
    return m.select("user_id", F.array_join(F.transform(F.map_entries("by_name"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("by_name"))


@query("select count(*) filter (o_orderstatus = 'F') as processed, count(*) filter (o_orderstatus <> 'F') as failed, count(*) as total from orders")
def folder_summary(spark, sf):
    return telemetry.outcomes(t(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "processed").otherwise("failed").alias("status")))


@query("select user_id as run_id, min(ts) filter (event_type = 'click') as started, max(ts) filter (event_type = 'purchase') as ended, round(epoch(max(ts) filter (event_type = 'purchase')) - epoch(min(ts) filter (event_type = 'click')), 3) as seconds from events group by 1 having min(ts) filter (event_type = 'click') is not null")
def run_table(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("run_id"), "ts", F.lit(True).alias("success"), F.when(F.col("event_type") == "click", "run_start").when(F.col("event_type") == "purchase", "run_end").alias("event"))
    return telemetry.run_table(e).select("run_id", "started", "ended", "seconds")


@query("select p_name || '_cash_flow.XLSX' as name, 'cash_flow' as statement_type, 'xlsx' as kind, p_partkey from part where p_partkey % 2 = 0")
def output_types(spark, sf):
    p = t(spark, sf, "part").select(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "_cash_flow.XLSX").otherwise("_x.json")).alias("name"), "p_partkey")
    return telemetry.output_types(p, workflow.TYPES)


@query("select p_partkey, case p_partkey % 2 when 0 then format('{:,}', p_partkey * 7919) else p_partkey * 7919 || ' x' end as shown, 'Cash Flow ' || p_partkey as title, len(p_name) // 4 as tokens, round(p_partkey / 1000, 3) as seconds, greatest(0, 2 - p_partkey % 4) as remaining, p_name as answer from part")
def display_texts(spark, sf):
    k = F.col("p_partkey")
    shown = F.when(k % 2 == 0, X.whole_number(k * 7919)).otherwise(F.concat((k * 7919).cast("string"), F.lit(" x")))
    answer = X.after_thought(F.when(k % 2 == 0, F.concat(F.lit("<think> a</think> response "), F.col("p_name"))).otherwise(F.col("p_name")))
    return t(spark, sf, "part").select("p_partkey", shown.alias("shown"), X.title_of(F.concat(F.lit("cash_flow_"), k)).alias("title"), X.token_estimate(F.col("p_name")).alias("tokens"), X.seconds_of(k).alias("seconds"), telemetry.quota_left(k % 4)[0].alias("remaining"), answer.alias("answer"))
