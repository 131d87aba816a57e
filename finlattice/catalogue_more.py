"""More queries of the library, each with its SQL twin: statements, accounts, matching, records and the workflow.

The workflow's models are stand-ins here: plain functions of the prompt whose answers SQL can say too.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from .catalogue import ORACLES, QUERIES, query, t
from .functions import text as X
from .operators import accounts, matching, memory, review, statements, telemetry, validation
from .plans import comparison, providers, workflow
from .sources import files, sinks, workbook

__all__ = ["ORACLES", "QUERIES"]

# -- statements of orders: flags are sections, lines are rows, every fourth line is a subtotal, every fifth has no label

_KIND = "case l_orderkey % 3 when 0 then 'balance_sheet' when 1 then 'income_statement' else 'cash_flow' end"
_LABEL = "case when l_linenumber % 5 = 0 then '' else 'part ' || l_partkey end"
_LINES = f"select l_orderkey as doc_id, {_KIND} as statement_type, l_returnflag as section, l_linenumber as line, {_LABEL} as label, l_linenumber % 4 = 0 as sub, l_quantity::bigint::varchar as a, case when l_linenumber % 3 > 0 then l_suppkey::varchar end as b, l_linenumber % 2 as short, l_partkey as pk, l_extendedprice as price from lineitem"
_PLACED = f"select *, dense_rank() over (partition by doc_id order by section) - 1 as section_pos, row_number() over (partition by doc_id, section order by line, pk, price) - 1 as row_pos from ({_LINES})"


def _statements(spark, sf):
    l = t(spark, sf, "lineitem")
    values = F.when(F.col("l_linenumber") % 2 == 1, F.array(F.col("l_quantity").cast("long").cast("string"))).otherwise(F.array(F.col("l_quantity").cast("long").cast("string"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_suppkey").cast("string"))))
    row = F.struct(F.col("l_linenumber").alias("line"), "l_partkey", "l_extendedprice", F.expr(_LABEL).alias("label"), values.alias("values"), (F.col("l_linenumber") % 4 == 0).alias("is_subtotal"))
    s = l.groupBy(F.col("l_orderkey").alias("doc_id"), F.expr(_KIND).alias("statement_type"), F.col("l_returnflag").alias("name")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    s = s.withColumn("rows", F.transform("rows", lambda r: r.dropFields("line", "l_partkey", "l_extendedprice")))
    g = s.groupBy("doc_id", "statement_type").agg(F.array_sort(F.collect_list(F.struct("name", "rows"))).alias("sections"))
    return g.withColumns({"title": F.lit("T"), "periods": F.array(F.lit("2024"), F.lit("2023"))})


@query(f"select doc_id, section_pos::int as section_pos, row_pos::int as row_pos, section, label, sub, case when period_pos = 0 then '2024' else '2023' end as period, case when period_pos = 0 then a else b end as value_raw, case when period_pos = 0 then a::double else b::double end as value_num from ({_PLACED}), (select unnest([0, 1]) as period_pos) where period_pos = 0 or short = 0")
def flat_cells(spark, sf):
    return statements.flatten(_statements(spark, sf)).select("doc_id", "section_pos", "row_pos", F.col("section_name").alias("section"), "label", F.col("is_subtotal").alias("sub"), "period", "value_raw", "value_num")


@query(f"select doc_id, section, row_pos::int as row_index, label, a || case when short = 0 then ',' || coalesce(b, '-') else '' end as figures from ({_PLACED}) where not sub and label <> ''")
def line_items(spark, sf):
    return statements.line_items(_statements(spark, sf)).select("doc_id", "section", "row_index", "label", F.array_join("values", ",", "-").alias("figures"))


@query(f"select doc_id, section, row_pos::int as row_pos, label, a || '|' || case when short = 0 then coalesce(b, '') else '' end as figures from ({_PLACED})")
def shown_rows(spark, sf):
    return statements.shown_rows(_statements(spark, sf)).select("doc_id", "section", "row_pos", "label", F.array_join("figures", "|").alias("figures"))


@query(f"select distinct doc_id, statement_type, statement_type = 'income_statement' as categorised from ({_LINES})")
def categorised_types(spark, sf):
    income, rest = review.gate(_statements(spark, sf))
    return income.withColumn("categorised", F.lit(True)).unionByName(rest.withColumn("categorised", F.lit(False))).select("doc_id", "statement_type", "categorised")


@query(f"""with p as (select *, (row_number() over (partition by doc_id order by section_pos, row_pos) - 1) // 3 as batch from ({_PLACED}) where not sub and label <> '')
select doc_id, batch::int as batch, '[' || string_agg('{{"label":"' || label || '","section":"' || section || '","values":["' || a || '"' || case when short = 0 then ',' || coalesce('"' || b || '"', 'null') else '' end || ']}}', ',' order by section_pos, row_pos) || ']' as lines from p group by 1, 2""")
def item_batches(spark, sf):
    items = statements.line_items(_statements(spark, sf)).withColumnRenamed("row_index", "row_pos")
    return workflow.item_batches(items, 3)


@query(f"""with s as (select *, row_pos + 1 as rn, count(*) over (partition by doc_id, section) as n from ({_PLACED})),
h as (select distinct doc_id, section, section_pos, n from s), o as (select *, 3 + coalesce(sum(n + 2) over (partition by doc_id order by section_pos rows between unbounded preceding and 1 preceding), 0) as top from h)
select doc_id, top::int as row_no, 1 as col_no, section as value, 'section' as style from o
union all select s.doc_id, (top + rn)::int, 1, label, case when sub then 'subtotal' else 'plain' end from s join o using (doc_id, section)
union all select s.doc_id, (top + rn)::int, 2, a, case when sub then 'subtotal' else 'plain' end from s join o using (doc_id, section)
union all select s.doc_id, (top + rn)::int, 3, b, case when sub then 'subtotal' else 'plain' end from s join o using (doc_id, section) where short = 0
union all select distinct doc_id, 1, 1, 'T', 'title' from s union all select distinct doc_id, 2, i + 1, ['Line Item', '2024', '2023'][i + 1], 'header' from s, (select unnest([0, 1, 2]) as i)""")
def statement_sheets(spark, sf):
    return review.sheet(_statements(spark, sf)).select("doc_id", "row_no", "col_no", "value", "style")


@query("""with o as (select o_orderkey as doc_id, case when o_orderkey % 2 = 0 then 'income_statement' else 'cash_flow' end as statement_type, o_orderstatus as title from orders)
select doc_id, statement_type, case when statement_type = 'income_statement' and title = 'F' then 'categorised' else title end as title from o""")
def preferred_statements(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, "income_statement").otherwise("cash_flow").alias("statement_type"), F.col("o_orderstatus").alias("title"))
    rich = o.where("statement_type = 'income_statement' and title = 'F'").withColumn("title", F.lit("categorised"))
    return sinks.preferred(o, rich)


@query("""with v as (select l_orderkey as doc_id, case when l_linenumber % 3 = 0 then 'Cash Out' else 'Cash from operations' end as label, l_linestatus as s, l_linenumber as n, (l_partkey, l_extendedprice) as pk, l_extendedprice - l_tax * 1000000::double as v from lineitem where l_returnflag = 'A' and l_linenumber % 2 = 0),
w as (select doc_id, (s = 'O')::int as period_pos, arg_max(v, (n, pk)) as v from v group by 1, 2) select doc_id, period_pos, 'negative_operating_cash' as "check", 'warning' as level, v as amount, 0.0::double as against from w where v < 0""")
def cash_findings(spark, sf):
    k = F.col("l_linenumber")
    cells = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "A", "Operating activities").otherwise("Investing").alias("section_name"), k.alias("section_pos"), F.struct("l_partkey", "l_extendedprice").alias("row_pos"), F.when(k % 3 == 0, "Cash Out").otherwise("Cash from operations").alias("label"), (k % 2 == 0).alias("is_subtotal"), (F.col("l_linestatus") == "O").cast("int").alias("period_pos"), (F.col("l_extendedprice") - F.col("l_tax") * F.lit(1000000.0)).alias("value_num"))
    return validation.cash_findings(cells)


@query("""with v as (select l_orderkey as doc_id, (l_linestatus = 'O')::int as period_pos, case l_linenumber % 4 when 0 then 'cost' when 1 then 'revenue' when 2 then 'gross' else 'net' end as m, arg_max(l_extendedprice * (1 + l_linenumber % 4)::double, (l_linenumber, l_partkey, l_extendedprice)) as v from lineitem group by 1, 2, 3),
w as (select doc_id, period_pos, max(v) filter (m = 'cost') as cost, max(v) filter (m = 'revenue') as revenue, max(v) filter (m = 'gross') as gross, max(v) filter (m = 'net') as net from v group by 1, 2)
select doc_id, period_pos, 'gross_gap' as "check", 'warning' as level, gross as amount, revenue - cost as against from w where abs(gross - (revenue - cost)) > greatest(abs(revenue) * 0.05::double, 10000.0)
union all select doc_id, period_pos, 'odd_margin', 'warning', net, revenue from w where revenue > 0 and abs(net) > revenue""")
def income_findings(spark, sf):
    k = F.col("l_linenumber") % 4
    label = F.when(k == 0, "Cost of sales").when(k == 1, "Total Revenue").when(k == 2, "Gross profit").otherwise("Net income")
    cells = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("S").alias("section_name"), F.col("l_linenumber").alias("section_pos"), F.struct("l_partkey", "l_extendedprice").alias("row_pos"), label.alias("label"), F.lit(False).alias("is_subtotal"), (F.col("l_linestatus") == "O").cast("int").alias("period_pos"), (F.col("l_extendedprice") * (k + 1).cast("double")).alias("value_num"))
    return validation.income_findings(cells)


@query("""with o as (select o_orderkey as doc_id, o_orderkey % 5 = 0 as e, o_orderkey % 7 = 0 as w from orders) select doc_id, 'x' as statement_type, not e as valid, (e::int)::bigint as errors, (w::int)::bigint as warnings from o""")
def verdicts(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("x").alias("statement_type"))
    found = o.where("doc_id % 5 = 0").withColumn("level", F.lit("error")).unionByName(o.where("doc_id % 7 = 0").withColumn("level", F.lit("warning")))
    return validation.verdicts(o, found)


_COMPANY = """select c_custkey as company, c_acctbal as b, c_custkey % 4 <> 0 as income, c_custkey % 3 = 0 as balance, c_custkey % 5 = 0 as cash from customer"""


def _company_cells(spark, sf):
    """Customers as companies; some lack a statement, and metrics stand in several."""
    b, k = F.col("c_acctbal"), F.col("c_custkey")
    cell = lambda kind, i, label, v, on: F.when(on, F.struct(F.lit(kind).alias("statement_type"), F.lit(0).alias("section_pos"), F.lit(i).alias("row_pos"), F.lit(label).alias("label"), v.cast("decimal(20,2)").cast("string").alias("value_raw")))
    cells = F.array_compact(F.array(
        cell("income_statement", 0, "Total revenue", b * 2, k % 4 != 0), cell("income_statement", 1, "Net income", b, k % 4 != 0), cell("income_statement", 2, "Total assets", b * 9, (k % 4 != 0) & (k % 2 == 0)),
        cell("balance_sheet", 0, "Total assets", b * 7, k % 3 == 0), cell("balance_sheet", 1, "Total equity", b * 3, k % 3 == 0), cell("balance_sheet", 2, "Revenue", b, k % 3 == 0),
        cell("cash_flow", 0, "Free cash flow", b * 5, k % 5 == 0), cell("income_statement", 3, "Free cash flow", b * 4, k % 4 != 0),
    ))
    return t(spark, sf, "customer").select(k.alias("company"), F.inline(cells))


_COMPANY_METRICS = f"""with c as ({_COMPANY}), d as (select company, b, income, balance, cash from c),
m as (select company, case when income then (b * 2)::decimal(20,2)::double end as revenue, case when income then b::decimal(20,2)::double end as net_income,
 case when income and company % 2 = 0 then (b * 9)::decimal(20,2)::double when balance then (b * 7)::decimal(20,2)::double end as total_assets,
 case when balance then (b * 3)::decimal(20,2)::double end as total_equity,
 case when cash then (b * 5)::decimal(20,2)::double when income then (b * 4)::decimal(20,2)::double end as free_cash_flow from d)"""


@query(f"""{_COMPANY_METRICS} select company, 'revenue' as metric, revenue as value from m where revenue is not null union all select company, 'net_income', net_income from m where net_income is not null
 union all select company, 'total_assets', total_assets from m where total_assets is not null union all select company, 'total_equity', total_equity from m where total_equity is not null union all select company, 'free_cash_flow', free_cash_flow from m where free_cash_flow is not null""")
def company_metrics(spark, sf):
    m = statements.company_metrics(_company_cells(spark, sf))
    return m.where("metric in ('revenue', 'net_income', 'total_assets', 'total_equity', 'free_cash_flow')")


@query(f"""{_COMPANY_METRICS} select company, revenue, net_income, total_assets, total_equity, case when revenue <> 0 then round(net_income / revenue * 100, 1) end as net_margin,
 case when total_equity <> 0 then round(net_income / total_equity * 100, 1) end as return_on_equity, case when total_assets <> 0 then round(net_income / total_assets * 100, 1) end as return_on_assets from m where coalesce(revenue, total_equity, free_cash_flow) is not null""")
def company_comparison(spark, sf):
    return comparison.compared(_company_cells(spark, sf)).select("company", "revenue", "net_income", "total_assets", "total_equity", "net_margin", "return_on_equity", "return_on_assets")


@query("select c_nationkey as company, max(c_custkey) as seq, arg_max(c_name, c_custkey) as title from customer group by 1")
def latest_companies(spark, sf):
    return statements.latest_companies(t(spark, sf, "customer").select(F.col("c_nationkey").alias("company"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("title")))


@query("select coalesce(arg_max(g, c_custkey) filter (g <> ''), arg_min('Y' || c_nationkey, c_custkey)) as fiscal_year from (select c_custkey, c_nationkey, case when c_custkey % 9 = 1 then 'FY' || c_custkey else '' end as g from customer)")
def fiscal_year(spark, sf):
    k = F.col("c_custkey")
    return statements.fiscal_year(t(spark, sf, "customer").select(k.alias("seq"), F.when(k % 9 == 1, F.concat(F.lit("FY"), k)).otherwise("").alias("given"), F.concat(F.lit("Y"), "c_nationkey").alias("stated")))


# -- the chart of accounts

_CHART = "select (1000 + p_partkey % 9000)::varchar as code, p_name as name, p_partkey as pos from part"


def _chart(spark, sf):
    k = F.col("p_partkey")
    return t(spark, sf, "part").select((1000 + k % 9000).cast("string").alias("code"), F.col("p_name").alias("name"), k.alias("pos"))


@query(f"""with c as ({_CHART}) select code, pos, 'income' as choice from c where code[1] between '5' and '9' union all select code, pos, 'code' from c where code = '1007' union all select code, pos, 'series' from c where code[1:2] = '10'
 union all select code, pos, 'category' from c where code[1:2] in ('10', '20') union all select code, pos, 'section' from c where code[1] = '1' and false union all select code, pos, 'any section' from c""")
def account_choices(spark, sf):
    c = _chart(spark, sf)
    picks = {"income": accounts.of_income_statements(c), "code": accounts.by_code(c, "1007"), "series": accounts.by_series(c, "1000"), "category": accounts.by_category(c, "Asset"), "section": accounts.in_section(c, "Cost of sales").where("code < '2'"), "any section": accounts.in_section(c, "")}
    out = [d.select("code", "pos", F.lit(k).alias("choice")) for k, d in picks.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4]).unionByName(out[5])


@query("select (5000 + p_partkey % 5000)::varchar as code, p_partkey as pos from part where ((5000 + p_partkey % 5000)::varchar)[1] = '5'")
def section_accounts(spark, sf):
    k = F.col("p_partkey")
    return accounts.in_section(t(spark, sf, "part").select((5000 + k % 5000).cast("string").alias("code"), k.alias("pos")), " Revenue ").select("code", "pos")


@query("""with n as (select p_partkey, p_name || case p_partkey % 3 when 0 then ' Services' when 1 then '/Tick, Cost' else ' & other' end as name from part),
w as (select p_partkey, unnest(list_filter(string_split(trim(replace(replace(replace(name, ',', ''), '&', ''), '/', ' ')), ' '), lambda x: len(x) > 2 and lower(x) not in ('services', 'cost', 'other', 'the', 'and'))) as a from n
 union select p_partkey, name from n union select p_partkey, trim(unnest(string_split(name, '/'))) from n where contains(name, '/'))
select lower(a) as alias, arg_max(p_partkey, p_partkey)::varchar as code from w group by 1""")
def alias_index(spark, sf):
    k = F.col("p_partkey")
    tail = F.when(k % 3 == 0, " Services").when(k % 3 == 1, "/Tick, Cost").otherwise(" & other")
    return accounts.alias_index(t(spark, sf, "part").select(k.cast("string").alias("code"), k.alias("pos"), F.concat("p_name", tail).alias("name")))


@query("""select n_nationkey as code, n_name as name, row_number() over (order by (lower(n_name) <> 'nation_7')::int, n_nationkey)::int as place from nation where contains(lower(n_name), 'nation_7') or contains('see nation_1' || n_nationkey % 9, 'nation_7')
 or (n_nationkey % 10 = 7 and contains('about nation_7', 'nation_7'))""")
def account_search(spark, sf):
    k = F.col("n_nationkey")
    about = F.when(k % 10 == 7, "about NATION_7").otherwise(F.concat(F.lit("see nation_1"), k % 9))
    n = t(spark, sf, "nation").select(k.alias("code"), F.col("n_name").alias("name"), about.alias("description"), k.alias("pos"))
    return matching.search(n, "Nation_7")


_GOODS = "select distinct split_part(p_name, ' ', 1) || ' goods' as name from part"
#: All that a match says, for labels without header or compound: overlap by tokens, layers by name.
_MATCH = f"""with a as (select name, row_number() over (order by name) as pos, {X.duck_tokens('name')} as nt from ({_GOODS})), l as (select distinct p_name as label, {X.duck_tokens('p_name')} as lt from part),
m as (select label, lt, name, pos, case when label = name then 1 when len(label) > 4 and contains(name, label) then 2 when len(name) > 4 and contains(label, name) then 3 else 4 end as layer,
  list_filter(lt, lambda p: len(list_filter(nt, lambda c: p = c or (len(p) >= 5 and len(c) >= 5 and (starts_with(p, c) or starts_with(c, p))))) > 0) as met from l, a),
h as (select *, len(met) / len(lt) as ratio, count(*) filter (len(met) > 0) over (partition by label) as n, row_number() over (partition by label order by (layer = 4)::int, case when layer < 4 then 0 else -(len(met) / len(lt)) end, pos) as rn from m where layer < 4 or len(met) > 0),
b as (select * from h where rn = 1), o as (select label, string_agg(pos, ',' order by rn) as alternatives from h where rn in (2, 3) and layer = 4 group by 1)"""


def _matches(spark, sf):
    from pyspark.sql import Window

    p = t(spark, sf, "part")
    # the names are a dimension of some dozen words
    a = p.select(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" goods")).alias("name")).distinct().withColumn("pos", F.row_number().over(Window.orderBy("name")).cast("long"))
    return matching.match(p.select(F.col("p_name").alias("label")), a.withColumn("code", F.col("pos")))


@query(f"""{_MATCH} select l.label, array_to_string(list_sort(list_filter(l.lt, lambda x: not list_contains(coalesce(met, []), x))), ' ') as unmatched, case when layer is null then null when layer <= 2 then l.label when layer = 3 then name else array_to_string(list_sort(met), ' ') end as matched_on,
 case when layer = 4 and ratio = 1 and n > 1 then alternatives end as alternatives from l left join b using (label) left join o using (label)""")
def match_details(spark, sf):
    return _matches(spark, sf).select("label", F.array_join(F.array_sort("unmatched"), " ").alias("unmatched"), F.array_join("matched_on", " ").alias("matched_on"), F.array_join("alternatives", ",").alias("alternatives"))


@query(f"""{_MATCH}, r as (select case when layer is null then 'unmatched' when layer <= 2 then 'high' when layer = 3 then 'medium' when ratio = 1 then (case when n = 1 then 'high' else 'ambiguous' end) else 'medium' end as c,
 case when layer is null then 'unmatched' when layer = 1 then 'exact' when layer < 4 then 'exact_substring' when ratio = 1 then 'token' else 'token_partial' end as k from l left join b using (label))
select count(*) as total, count(*) filter (c = 'high') as auto, count(*) filter (c <> 'high') as review, count(*) filter (c = 'high') / count(*) as match_rate,
 (select string_agg(c || '=' || n, ',' order by c) from (select c, count(*) as n from r group by 1)) as by_confidence, (select string_agg(k || '=' || n, ',' order by k) from (select k, count(*) as n from r group by 1)) as by_match_type from r""")
def match_totals(spark, sf):
    shown = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias(c)
    return matching.totals(_matches(spark, sf)).select("total", "auto", "review", "match_rate", shown("by_confidence"), shown("by_match_type"))


@query("""with o as (select o_orderkey as row_pos, 'k' || o_orderkey % 9 as label, o_orderkey % 9 as k from orders),
c as (select *, case when k in (1, 2) then 'token' when k = 3 then 'exact' when k = 4 then 'exact_substring' when k in (5, 6) then 'llm' else 'unmatched' end as match_type, case when k between 1 and 4 then '50' || k || '0' when k in (5, 6) then '7' || k || '00' end as coa_code from o)
select row_pos, label, coa_code, match_type, case when k in (1, 2) then 'medium' when k in (3, 4) then 'high' when k in (5, 6) then 'high' else 'unmatched' end as confidence, not coalesce(k in (3, 4, 5, 6), false) as needs_review,
 case when k in (1, 2, 3, 4) then 'VMG/AAHA CoA p.' || coa_code[1:2] || '00' when k in (5, 6) then 'VMG/AAHA DATALINK Definitions' else 'N/A - needs human review' end as citation,
 case when k = 1 then 'Token match on ''a, b'' → ' || coa_code || ' n1' when k = 2 then 'Token match on ''unknown token'' → ' || coa_code || ' n2' when k = 3 then 'Exact name match → ' || coa_code || ' n3' when k = 4 then 'Substring match (''sub'') → ' || coa_code || ' n4'
 when k in (5, 6) then 'r' else 'No account found; needs a person' end as reasoning from c""")
def matched_before_answers(spark, sf):
    """Token results go before a model's answers: labels k1 to k4 have both."""
    k = F.col("o_orderkey")
    rows = t(spark, sf, "orders").select(F.lit(0).alias("doc_id"), F.lit(0).alias("section_pos"), F.lit("s").alias("section"), k.alias("row_pos"), F.concat(F.lit("k"), k % 9).alias("label"), F.lit(False).alias("is_subtotal"))
    answers = spark.createDataFrame([(f"k{i}", 0, f"7{i}00", "n", "c", "high", "r", False, False) for i in range(1, 7)], "label string, seq int, " + workflow.RECORD.split(", ", 1)[1])
    found = spark.createDataFrame([("k1", "5010", "n1", "c", "token", "medium", ["a", "b"]), ("k2", "5020", "n2", "c", "token", "medium", []), ("k3", "5030", "n3", "c", "exact", "high", ["k3"]), ("k4", "5040", "n4", "c", "exact_substring", "high", ["sub"]), ("k5", None, None, None, "unmatched", "unmatched", [])], "label string, code string, name string, category string, match_type string, confidence string, matched_on array<string>")
    return review.categorise(rows, answers, found).select("row_pos", "label", "coa_code", "match_type", "confidence", "needs_review", "citation", "reasoning")


@query("select p_partkey, h in ('Total Revenue', 'Gross Profit', 'revenue') as header from (select p_partkey, ['Total Revenue', 'Gross Profit', 'Rent', 'revenue', 'Vaccines'][1 + p_partkey % 5] as h from part)")
def posted_items(spark, sf):
    items = t(spark, sf, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, ["Total Revenue", "Gross Profit", "Rent", "revenue", "Vaccines"])), (1 + F.col("p_partkey") % 5).cast("int")).alias("label"))
    heads, rest = review.postable(items)
    return heads.select("p_partkey", F.lit(True).alias("header")).unionByName(rest.select("p_partkey", F.lit(False).alias("header")))


# -- records and files

@query("select user_id as practice_id, 'l' || event_id as label, event_type as section, 'w' || event_id % 3 as wrong_code, 'c' || event_id % 5 as correct_code, 'n' as correct_name, (1 + event_id % 4)::int as count from events")
def rule_files(spark, sf):
    """Rules written as Markdown tables and parsed again."""
    k = F.col("event_id")
    rules = t(spark, sf, "events").select(F.col("user_id").cast("string").alias("practice_id"), F.concat(F.lit("l"), k).alias("label"), F.col("event_type").alias("section"), F.concat(F.lit("w"), k % 3).alias("wrong_code"), F.concat(F.lit("c"), k % 5).alias("correct_code"), F.lit("n").alias("correct_name"), (1 + k % 4).alias("count"), k.alias("seq"))
    return files.rules_of(sinks.rule_files(rules)).drop("seq").withColumn("practice_id", F.col("practice_id").cast("long"))


@query("select 'U' || c_custkey as user_id, case when c_custkey % 5 = 0 then 'pro' else 'free' end as tier, (c_custkey % 4)::int as current_month_count, '2024-0' || (1 + c_custkey % 2) as month_start, c_custkey::int as total_extractions from customer")
def usage_documents(spark, sf):
    """The usage document, written as JSON and read again."""
    return files.usage_of(sinks.usage_json(_usage(spark, sf)))


def _usage(spark, sf):
    k = F.col("c_custkey")
    return t(spark, sf, "customer").select(F.concat(F.lit("U"), k).alias("user_id"), F.when(k % 5 == 0, "pro").otherwise("free").alias("tier"), (k % 4).cast("int").alias("current_month_count"), F.concat(F.lit("2024-0"), 1 + k % 2).alias("month_start"), k.cast("int").alias("total_extractions"))


@query("""with u as (select 'U' || c_custkey as user_id, case when c_custkey % 5 = 0 then 'pro' else 'free' end as tier, case when c_custkey % 2 = 0 then (c_custkey % 4)::int else 0 end as used from customer)
select *, tier = 'pro' or used < 2 as allowed, case when tier <> 'pro' then greatest(0, 2 - used) end as remaining, case when tier <> 'pro' then used / 2 end as progress from u""")
def usage_states(spark, sf):
    return telemetry.usage_state(_usage(spark, sf), F.lit("2024-01"))


@query("""with e as (select * from events), r as (select count(*) as total_runs, round(count(*) filter (event_type <> 'error') * 100 / count(*), 1) as success_rate, round(avg(value), 1) as avg_seconds, round(avg(event_id % 3), 2) as avg_retries from e where ts > (select max(ts) from e) - interval 7 days)
select event_id as run_id, strftime(ts, '%Y-%m-%d %H:%M') as shown_at, 'f' || user_id as pdf_file, event_type <> 'error' as success, value as seconds, event_id % 7 as calls, event_id % 3 as retries, r.* from (select * from e order by ts desc, event_id desc limit 20), r""")
def dashboard(spark, sf):
    e = t(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))
    runs = e.join(F.broadcast(now)).select(F.col("event_id").alias("run_id"), "ts", "now", F.concat(F.lit("f"), "user_id").alias("pdf_file"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("seconds"), (F.col("event_id") % 7).alias("calls"), (F.col("event_id") % 3).alias("retries"))  # one row
    return telemetry.dashboard(runs, F.col("now"))


@query("select event_id as run_id, ts, value as seconds, row_number() over (order by ts, event_id)::int as place from (select * from events order by ts desc, event_id desc limit 20)")
def trend(spark, sf):
    from pyspark.sql import Window

    runs = t(spark, sf, "events").select(F.col("event_id").alias("run_id"), "ts", F.col("value").alias("seconds"))
    return telemetry.trend(runs).withColumn("place", F.row_number().over(Window.orderBy("ts", "run_id")))  # 20 rows


@query("select count(distinct o_custkey) as extracted, count(*) filter (o_orderkey % 3 = 0) as xlsx, count(*) filter (o_orderkey % 3 = 1) as json from orders")
def file_counters(spark, sf):
    end = F.when(F.col("o_orderkey") % 3 == 0, ".xlsx").when(F.col("o_orderkey") % 3 == 1, ".json").otherwise(".txt")
    return telemetry.file_counters(t(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.concat(F.col("o_orderkey").cast("string"), end).alias("name")))


@query("select s_suppkey, case when s_suppkey % 3 = 0 then (s_suppkey % 50)::int end as pages, s_suppkey % 4 + 1 as first_page, 'd' || s_suppkey || '_cash_flow_20240102_030405' as name from supplier")
def page_counts(spark, sf):
    k = F.col("s_suppkey")
    info = F.concat(F.lit("Title: x\n"), F.when(k % 3 == 0, F.concat(F.lit("Pages:   "), (k % 50).cast("string"))).otherwise("Pages: many"), F.lit("\nEnd"))
    return t(spark, sf, "supplier").select("s_suppkey", files.page_count(info).alias("pages"), F.get(files.page_numbers(F.array(k % 4)), F.lit(0)).alias("first_page"), workflow.file_name(F.concat(F.lit("d"), k), F.lit("cash_flow"), F.to_timestamp(F.lit("2024-01-02 03:04:05"))).alias("name"))


@query("""select p_partkey, format('{:,.0f}', p_partkey / 2) as whole, format('{:,.1f}', p_partkey / 800 * 100) || '%' as share, p_partkey % 3 <> 2 as yes, 'p' || p_partkey as rest, '{' || chr(10) || '  "a" : ' || p_partkey || ',' || chr(10) || '  "b" : null' || chr(10) || '}' as encoded from part""")
def number_texts(spark, sf):
    k = F.col("p_partkey")
    said = F.when(k % 3 == 0, " yes, it does").when(k % 3 == 1, "YES").otherwise("No, YES")
    thought = X.after_thought(F.concat(F.lit("<think>x</think> a response "), F.concat(F.lit("p"), k)))
    encoded = sinks.statement_json(F.struct(k.alias("a"), F.lit(None).cast("string").alias("b")))
    return t(spark, sf, "part").select("p_partkey", X.whole_number(k / 2).alias("whole"), X.percent(k / 800).alias("share"), providers.says_yes(said).alias("yes"), thought.alias("rest"), encoded.alias("encoded"))


@query("""with o as (select o_orderkey as doc_id, 1 + o_orderkey % 5 as total from orders), p as (select doc_id, unnest(range(1, total + 1)) as page_num from o)
select doc_id, page_num::int as page_num, 'Page ' || page_num || case when (page_num = 2 or page_num = 4) and doc_id % 2 = 0 then ' ✓' else '' end as shown from p""")
def page_marks(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (1 + F.col("o_orderkey") % 5).alias("total_pages"))
    marks = o.where("doc_id % 2 = 0").select("doc_id", F.explode(F.array(F.lit(2), F.lit(4), F.lit(2))).alias("page_num"))
    return statements.page_marks(o, marks)


_ASKED = ["all", " Cash_Flow, x,cash_flow", "", "income_statement,all", "nothing"]
_EVERY = "['balance_sheet', 'income_statement', 'cash_flow']"


@query(f"""with l as (select p_partkey, unnest(case p_partkey % 6 when 0 then {_EVERY} when 1 then ['cash_flow', 'cash_flow'] when 3 then ['income_statement', 'balance_sheet', 'income_statement', 'cash_flow'] else {_EVERY} end) as kind from part)
select p_partkey, kind, count(*) as n from l group by 1, 2""")
def statement_types(spark, sf):
    """Requests of five kinds and null ones, by part."""
    k = F.col("p_partkey")
    asked = F.get(F.array(*map(F.lit, _ASKED)), (k % 6).cast("int"))
    return t(spark, sf, "part").select("p_partkey", F.explode(workflow.types_of(asked)).alias("kind")).groupBy("p_partkey", "kind").agg(F.count("*").alias("n"))


_TABLES = ["benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier"]


@query(f"select unnest({_TABLES}) as stem, unnest([{', '.join('true' if n == 'nation' else 'false' for n in _TABLES)}]) as chosen")
def report_files(spark, sf):
    """The tables' own files as a folder of reports; a table of several files is one."""
    found = files.reports(spark, sf, "*.parquet", whole=True).where(F.col("stem").isin(_TABLES)).select(F.col("stem").alias("stem"))
    one = files.listed(spark, sf, "nation*", whole=True).where("stem = 'nation'").select("stem").distinct().withColumn("chosen", F.lit(True))
    return found.distinct().join(one, "stem", "left").select("stem", F.coalesce("chosen", F.lit(False)).alias("chosen"))


@query("select n_nationkey::varchar as code, n_name as name, case when n_nationkey % 2 = 0 then 'about ' || n_name end as description, n_nationkey::int as pos from nation")
def chart_documents(spark, sf):
    """A chart of accounts as one JSON text, parsed."""
    k = F.col("n_nationkey")
    account = F.struct(k.cast("string").alias("code"), F.col("n_name").alias("name"), F.when(k % 2 == 0, F.concat(F.lit("about "), "n_name")).alias("description"))
    one = t(spark, sf, "nation").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), account.alias("a")))), lambda x: x["a"])).alias("value"))  # a chart is one small document
    return files.accounts_of(one)


@query(f"select doc_id, section, row_pos::int as row_pos, label, sub, a || case when short = 0 then ',' || coalesce(b, '-') else '' end as figures from ({_PLACED}) where doc_id % 7 > 0 union all select distinct doc_id, null, null, null, null, null from ({_LINES}) where doc_id % 7 = 0")
def statement_documents(spark, sf):
    """Statements written as JSON and parsed; every seventh text is broken."""
    s = _statements(spark, sf)
    text = F.when(F.col("doc_id") % 7 == 0, "{broken").otherwise(sinks.statement_json(F.struct("title", "statement_type", "periods", "sections")))
    back = files.statements_of(s.select("doc_id", text.alias("value")))
    rows = back.select("doc_id", F.explode_outer("sections").alias("s")).select("doc_id", F.col("s.name").alias("section"), F.posexplode_outer("s.rows").alias("row_pos", "r"))
    return rows.select("doc_id", "section", "row_pos", F.col("r.label").alias("label"), F.col("r.is_subtotal").alias("sub"), F.array_join("r.values", ",", "-").alias("figures"))


@query("select 'r' || event_id as run_id, value as total_duration, (event_id % 7)::int as llm_calls, (event_id % 3)::int as retries, event_type <> 'error' as success, case when event_type = 'error' then 'e' end as error_message from events")
def run_documents(spark, sf):
    k = F.col("event_id")
    run = F.struct(F.concat(F.lit("r"), k).alias("run_id"), F.col("value").alias("total_duration"), (k % 7).alias("llm_calls"), (k % 3).alias("retries"), (F.col("event_type") != "error").alias("success"), F.when(F.col("event_type") == "error", "e").alias("error_message"))
    return files.runs_of(t(spark, sf, "events").select(F.to_json(run).alias("value"))).drop("timestamp")


@query("select ts as timestamp, event_type as event, user_id::varchar as run_id, (event_id % 5000)::double as duration_ms from events where event_id % 4 > 0")
def event_lines(spark, sf):
    k = F.col("event_id")
    line = sinks.log_line(F.col("ts").alias("timestamp"), F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("run_id"), (k % 5000).alias("duration_ms"))
    return files.events_of(t(spark, sf, "events").select(F.when(k % 4 == 0, "{").otherwise(line).alias("value")))


@query("select p_partkey, base64(encode(repeat(p_name, 20))) as shown from part")
def encoded_images(spark, sf):
    return t(spark, sf, "part").select("p_partkey", files.encoded(F.encode(F.repeat("p_name", F.lit(20)), "UTF-8")).alias("shown"))


@query("""with o as (select o_custkey, o_orderkey, o_orderpriority, o_totalprice, row_number() over (partition by o_custkey order by o_orderkey) as n from orders)
select 'c' || o_custkey || '.xlsx' as name, 'Orders & <sums>' as sheet, n::int as row_no, 1 as col_no, o_orderkey::varchar as value from o union all select 'c' || o_custkey || '.xlsx', 'Orders & <sums>', n::int, 2, o_orderpriority from o""")
def workbooks(spark, sf):
    """A spreadsheet per customer, written and read again."""
    from pyspark.sql import Window

    o = t(spark, sf, "orders").withColumn("row_no", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    cell = lambda i, c: F.struct(F.lit(i).alias("col_no"), F.col(c).cast("string").alias("value"), F.lit("plain").alias("style"))
    cells = o.select(F.concat(F.lit("c"), "o_custkey", F.lit(".xlsx")).alias("name"), F.lit("Orders & <sums>").alias("sheet"), "row_no", F.inline(F.array(cell(1, "o_orderkey"), cell(2, "o_orderpriority"))))

    return workbook.cells_in(workbook.files(cells))


@query("select event_type as node, case when event_id % 9 = 0 then 0 else len(event_type) // 4 end as response_tokens, event_id % 9 > 0 as success, count(*) as n from events group by all")
def call_events(spark, sf):
    """Calls as events: nodes, token estimates, failures."""
    k = F.col("event_id")
    e = t(spark, sf, "events").select("event_type", F.when(k % 9 > 0, F.col("event_type")).alias("answer"), F.when(k % 9 == 0, "down").alias("error"), F.lit(1.0).alias("ms"))
    logs = [providers.call_log(e.where(F.col("event_type") == n), n) for n in ("click", "view", "purchase", "error", "signup")]
    every = logs[0].unionByName(logs[1]).unionByName(logs[2]).unionByName(logs[3]).unionByName(logs[4])
    return every.groupBy("node", "response_tokens", "success").agg(F.count("*").alias("n"))


# -- the workflow over documents: a document's pages are its parts of 300 characters

_PAGES = "select doc_id, i + 1 as page_num, substr(text, 1 + i * 300, 300) as text from (select doc_id, text, unnest(range(0, greatest(1, (len(text) + 299) // 300))) as i from documents)"


def _pages(spark, sf):
    last = F.greatest(F.lit(0), F.floor((F.length("text") + 299) / 300).cast("int") - 1)
    d = t(spark, sf, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return d.select("doc_id", (F.col("i") + 1).alias("page_num"), F.expr("substring(text, 1 + i * 300, 300)").alias("text"))


def _detector(prompts, images):
    """Pages whose preview holds an `e` right after its head hold income statements; page 2 holds a cash flow, and a page that isn't there."""
    out = []
    for p in prompts:
        body = p.split("\n\n", 1)[1]
        pages = [int(n) for n, first in re.findall(r"(?:^|\n---\n\n)Page (\d+):\n(.?)", body) if first and first in "aeiouAEIOU"]
        out.append("<think>{}</think>```json\n" + json.dumps({"income_statement": pages, "cash_flow": [2, 0, "x"]}) + "\n```")
    return out


_FOUND = f"""with p as ({_PAGES}), k as (select doc_id, count(*) as total, sum(len(text)) > 100 as has from p group by 1),
f as (select p.doc_id, 'income_statement' as statement_type, page_num from p join k using (doc_id) where has and len(text) > 0 and contains('aeiouAEIOU', text[1]) union all select doc_id, 'cash_flow', 2 from k where has and total >= 2),
m as (select doc_id, statement_type, (row_number() over (partition by doc_id, statement_type order by page_num) - 1)::int as page_pos, page_num::int as page_num from f)"""


@query(f"{_FOUND} select * from m")
def detected_pages(spark, sf):
    return workflow.detect(_pages(spark, sf), _detector)


@query(f"{_FOUND}, n as (select doc_id, count(*) as n_pages from m group by 1) select d.doc_id, coalesce(n_pages, 0) as n_pages, case when n_pages is null then 'No statement pages found' end as detect_error from documents d left join n on n.doc_id = d.doc_id")
def detection_outcomes(spark, sf):
    pages = _pages(spark, sf)
    return workflow.pages_found(pages, workflow.detect(pages, _detector))


def _looker(prompts, images):
    out = []
    for p, image in zip(prompts, images, strict=True):
        n = len(bytes(image))
        out.append(("Yes." if n % 2 else "No.") if "YES or NO" in p else "no JSON" if n % 7 == 0 else json.dumps({"balance_sheet": n % 2 == 1, "cash_flow": "x", "income_statement": n % 3 == 0}))
    return out


_IMAGES = "select doc_id, 1 as page_num, octet_length(encode(text)) as n from documents where len(text) > 0"


def _images(spark, sf):
    return t(spark, sf, "documents").where("length(text) > 0").select("doc_id", F.lit(1).alias("page_num"), F.lit("").alias("text"), F.encode("text", "UTF-8").alias("image"))


@query(f"with i as ({_IMAGES}) select doc_id, page_num, unnest(['balance_sheet', 'income_statement', 'cash_flow']) as statement_type, unnest([n % 7 > 0 and n % 2 = 1, n % 7 > 0 and n % 3 = 0, false]) as flag from i")
def page_flags(spark, sf):
    return workflow.page_flags(_images(spark, sf), _looker)


@query(f"select doc_id, page_num, n % 2 = 1 as yes from ({_IMAGES})")
def page_answers(spark, sf):
    return workflow.page_is(_images(spark, sf), _looker, "cash_flow")


@query(f"select doc_id, 'balance_sheet' as statement_type, 0 as page_pos, 1 as page_num from ({_IMAGES}) where n % 7 > 0 and n % 2 = 1")
def balance_sheet_pages(spark, sf):
    """Pages without text are shown as images."""
    return workflow.balance_sheet_pages(_images(spark, sf), _looker)


def _reader(prompts, images):
    """A page's statement: its first two words as rows; pages that begin with a capital can't be read unless their mistake is told."""
    out = []
    for p in prompts:
        text = p.split("\n", 1)[1].split("\nMend this: ")[0]
        words = re.findall(r"[a-z]+", text)[:2]
        if text[:1].isascii() and text[:1].isupper() and "Mend this" not in p:
            words = []
        rows = [{"label": w, "values": [str(len(w))], "is_subtotal": False} for w in words]
        out.append(json.dumps({"title": "t", "periods": ["2024"], "sections": [{"name": "S", "rows": rows}]}))
    return out


def _strict(prompts, images):
    return [json.dumps({"scores": {"completeness": 9}, "passed": '"label"' in p, "feedback": "rows are missing"}) for p in prompts]


#: Of each page, the words it gives at first, and on the second attempt.
_READ = f"""{_FOUND}, g as (select m.*, case when p.text[1] between 'A' and 'Z' then [] else regexp_extract_all(p.text, '[a-z]+')[1:2] end as w1, regexp_extract_all(p.text, '[a-z]+')[1:2] as w2 from m join p using (doc_id, page_num)),
s as (select doc_id, statement_type, sum(len(w1)) > 0 as ok1, sum(len(w2)) > 0 as ok2, sum(len(w1)) as n1, sum(len(w2)) as n2 from g group by 1, 2),
a as (select doc_id, bool_and(ok1) as first from s group by 1)"""


@query(f"{_READ} select doc_id, statement_type, case when first then 1 else 2 end as attempt, case when first then ok1 when not ok1 then ok2 else ok1 end as passed, (case when first then n1 when not ok1 then n2 else n1 end)::int as n_rows from s join a using (doc_id)")
def extracted_statements(spark, sf):
    """Documents with a failed statement are extracted again, all of them; only failed statements are told their mistakes."""
    pages = _pages(spark, sf)
    s, v = workflow.extract_and_judge(pages, workflow.detect(pages, _detector), _reader, _strict)
    n = s.select("doc_id", "statement_type", F.size(F.flatten("sections.rows")).alias("n_rows"))
    return v.join(n, ["doc_id", "statement_type"]).select("doc_id", "statement_type", "attempt", "passed", "n_rows")


def _bookkeeper(prompts, images):
    """Accounts of words: known ones with an `a`, doubtful ones with an `e`, until they are asked again; no answer for others."""
    out = []
    for p in prompts:
        again = "look again" in p
        items = json.loads(p[p.rindex("\n") + 1 :])
        out.append(json.dumps([{"label": x["label"], "account_id": "7" + str(len(x["label"])), "account_name": "n", "category": "c", "confidence": "high" if again or "a" in x["label"] else "low", "reasoning": "r"} for x in items if "a" in x["label"] or "e" in x["label"]]))
    return out


def _auditor(prompts, images):
    return ["no JSON" if '"coverage":1.0' in p else json.dumps({"passed": False, "feedback": "again", "scores": {}}) for p in prompts]


_BOOKED = f"""{_READ}, r as (select g.doc_id, unnest(case when first then w1 when ok1 then w1 else w2 end) as label from g join s using (doc_id, statement_type) join a using (doc_id) where statement_type = 'income_statement'),
q as (select doc_id, label, contains(label, 'a') as sure, contains(label, 'a') or contains(label, 'e') as known, regexp_matches(label, '^(revenue|expenses?|income)$') as head from r),
c as (select doc_id, count(*) filter (known and not head) as mapped, count(*) filter (not head) as postable from q group by 1), v as (select doc_id, coalesce(mapped / nullif(postable, 0), 0) as coverage from c)"""


@query(f"""{_BOOKED} select doc_id, label, case when head then null when known then '7' || len(label) end as coa_code, case when head then 'section_header' when not known then 'unmatched' when sure or coverage >= 0.9995 then 'llm' else 'llm_retry' end as match_type, count(*) as n from q join v using (doc_id) group by 1, 2, 3, 4""")
def booked_rows(spark, sf):
    rows, _ = _flow(spark, sf)
    return rows.groupBy("doc_id", "label", "coa_code", "match_type").agg(F.count("*").alias("n"))


@query(f"{_BOOKED} select doc_id, coverage >= 0.9995 as passed, false as hard_fail from v")
def booking_verdicts(spark, sf):
    _, verdicts = _flow(spark, sf)
    return verdicts.select("doc_id", "passed", "hard_fail")


def _flow(spark, sf):
    pages = _pages(spark, sf)
    s, _ = workflow.extract_and_judge(pages, workflow.detect(pages, _detector), _reader, _strict)
    chart = spark.createDataFrame([("7001", "Rent", None, 0)], "code string, name string, description string, pos int")
    return workflow.categorise(s, chart, _bookkeeper, _auditor)


@query(f"""{_READ}, h as (select distinct doc_id from s) select d.doc_id, case when h.doc_id is not null then 'processed' else 'failed' end as status, case when h.doc_id is null then 'No statement pages found' end as detect_error, case when h.doc_id is null then 'No data to save' end as save_error from documents d left join h using (doc_id)""")
def run_outcomes(spark, sf):
    """The whole flow, from pages to what became of each document."""
    return workflow.run(_pages(spark, sf), lambda p, i: _detector(p, i) if p[0].startswith("Which") else _reader(p, i), _strict).outcome


@query("""with e as (select user_id as doc_id, event_type, count(*) filter (event_type = 'click' and event_id % 4 = 1) as n1, count(*) filter (event_type = 'view' and event_id % 4 = 2) as n2 from events group by 1, 2)
select doc_id, (sum(n1) + sum(n2))::bigint as ignored, sum(n2) > 0 as hard_fail from e group by 1""")
def hard_fails(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("label"), F.concat(F.lit("w"), F.col("event_id") % 4).alias("coa_code"), F.lit("llm").alias("match_type"), F.lit(None).cast("string").alias("line_type"), F.lit("high").alias("confidence"), F.lit(False).alias("needs_review"))
    rules = spark.createDataFrame([("Click", "w1", "c", 1), ("View", "w2", "c", 3)], "label string, wrong_code string, correct_code string, count int")
    return workflow.precheck(e, rules).select("doc_id", "ignored", "hard_fail")


@query("""select o_orderkey as doc_id, case when o_orderkey % 3 = 0 then 0.5 when o_orderkey % 3 = 1 then 1.0 else 0.0 end * 10 = 10 as passed, round(10 * (case when o_orderkey % 3 = 0 then 0.5 when o_orderkey % 3 = 1 then 1.0 else 0.0 end)::double) as completeness from orders""")
def rule_judge(spark, sf):
    """The judge without a model: a statement without missing figures passes."""
    k = F.col("o_orderkey")
    values = F.when(k % 3 == 0, F.array(F.lit("1"), F.lit("null"))).when(k % 3 == 1, F.array(F.lit("1"))).otherwise(F.array(F.lit("")))
    row = F.struct(F.lit("x").alias("label"), values.alias("values"), F.lit(False).alias("is_subtotal"))
    s = t(spark, sf, "orders").select(k.alias("doc_id"), F.lit("cash_flow").alias("statement_type"), F.array(F.lit("p")).alias("periods"), F.array(F.struct(F.lit("n").alias("name"), F.array(row).alias("rows"))).alias("sections"))
    return workflow.judge(s).select("doc_id", "passed", F.element_at("scores", "completeness").alias("completeness"))


@query("select c_custkey, string_agg(o_orderkey, ',' order by o_orderkey) as keys from customer join orders on c_custkey = o_custkey where o_orderkey % 3 < 2 group by 1")
def learned_rules(spark, sf):
    """Practice rules over default ones, by practice."""
    o = t(spark, sf, "orders").where("o_orderkey % 3 < 2").select(F.col("o_custkey").cast("string").alias("label"), F.col("o_orderkey").cast("string").alias("section"), F.col("o_orderkey").alias("correct_code"), F.lit(1).alias("seq"))
    both = memory.override(o.where("correct_code % 3 = 0").withColumn("correct_code", F.lit(-1).cast("long")).unionByName(o.where("correct_code % 3 = 1")), o.where("correct_code % 3 = 0"))
    return both.groupBy(F.col("label_key").cast("long").alias("c_custkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("correct_code")), lambda x: x.cast("string")), ",").alias("keys"))
