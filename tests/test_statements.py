"""Statements from pages to categorised sheets, on small fixtures with results worked out by hand."""

import json

from pyspark.sql import functions as F

from finlattice.operators import accounts, matching, review, validation
from finlattice.operators import statements as S

STATEMENT = "doc_id string, statement_type string, title string, periods array<string>, sections array<struct<name string, rows array<struct<label string, values array<string>, is_subtotal boolean>>>>"


def rows(*rs):
    return [(label, list(values), sub) for label, values, sub in rs]


def frame(spark, *docs):
    return spark.createDataFrame(list(docs), STATEMENT)


def test_balance(spark):
    total = lambda *v: rows(("Total", v, True))
    docs = frame(
        spark,
        ("ok", "balance_sheet", "t", ["a", "b"], [("Assets", total("5,000", "9,000")), ("Liabilities", total("2,000", "2,000")), ("Equity", total("2,100", "1"))]),
        ("last", "balance_sheet", "t", ["a"], [("Assets", total("5,000")), ("assets", total("7,000")), ("Liabilities", total("1,000")), ("Equity", total("4,000"))]),
        ("gone", "balance_sheet", "t", ["a", "b"], [("Assets", total("5,000", "5,000")), ("Other assets", total("1", "")), ("Liabilities", total("1", "1")), ("Equity", total("1", "1"))]),
        ("neg", "balance_sheet", "t", ["a"], [("Assets", rows(("Cash", ["(5)"], False), ("Accumulated wear", ["(9)"], False)))]),
    )
    cells = S.flatten(docs)
    totals = {(r.doc_id, r.period_pos): (r.assets, r.liabilities, r.equity) for r in validation.role_totals(cells).collect()}
    assert totals[("ok", 0)] == (5000, 2000, 2100) and totals[("last", 0)][0] == 7000 and totals[("gone", 0)][0] == 1 and totals[("gone", 1)][0] is None
    found = validation.findings(cells)
    assert {(r.doc_id, r.period_pos, r.check, r.amount) for r in found.collect()} == {("ok", 1, "unbalanced", 9000.0), ("last", 0, "unbalanced", 7000.0), ("neg", 0, "negative_asset", -5.0)}
    assert {(r.doc_id, r.valid, r.warnings) for r in validation.verdicts(docs, found).collect()} == {("ok", False, 0), ("last", False, 0), ("gone", True, 0), ("neg", True, 1)}


def test_income_and_cash(spark):
    income = rows(("Revenue", ["100,000"], False), ("Cost of revenue", ["40,000"], False), ("Gross profit", ["90,000"], False), ("Net income", ["(200,000)"], False))
    cash = rows(("Net cash", ["5"], True), ("Net cash used", ["(7)"], True), ("Cash", ["(9)"], False))
    cells = S.flatten(frame(spark, ("i", "income_statement", "t", ["a"], [("All", income)]), ("c", "cash_flow", "t", ["a"], [("Operating activities", cash)])))
    assert {(r.doc_id, r.check, r.amount, r.against) for r in validation.findings(cells).collect()} == {("i", "gross_gap", 90000.0, 60000.0), ("i", "odd_margin", -200000.0, 100000.0), ("c", "negative_operating_cash", -7.0, 0.0)}
    assert validation.findings(cells, compat=True).count() == 0


def test_sections_and_structure(spark):
    docs = frame(spark, ("b", "balance_sheet", "t", [], [("Current assets", []), (None, []), ("Total Equity", [])]), ("o", "other", "t", [], []))
    assert {(r.doc_id, tuple(r.missing)) for r in validation.missing_sections(docs).collect()} == {("b", ("LIABILIT",)), ("o", ())}
    ok = {"title": "t", "periods": ["a"], "sections": [{"name": "n", "rows": [{"label": "l", "values": []}]}]}
    texts = {
        "ok": json.dumps(ok),
        "null": json.dumps(ok | {"title": None}),
        "keys": json.dumps({"periods": []}),
        "text": "no JSON",
        "list": "[1]",
        "empty": json.dumps(ok | {"periods": [], "sections": "x"}),
        "deep": json.dumps(ok | {"sections": [{"rows": 5}, {"name": "n"}, {"name": "n", "rows": [{"label": "l"}, {}]}]}),
    }
    got = {r.doc_id: r.errors for r in validation.structure_errors(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    every = [f"Missing required key: {k}" for k in ("title", "periods", "sections")]
    assert got == {
        "ok": [],
        "null": [],
        "keys": [every[0], every[2]],
        "text": every,
        "list": every,
        "empty": ["Periods must be a non-empty list", "Sections must be a non-empty list"],
        "deep": ["Section 0 missing 'name' field", "Section 0 'rows' must be a list", "Section 1 missing 'rows' field", "Section 2, row 0 missing 'values'", "Section 2, row 1 missing 'label'", "Section 2, row 1 missing 'values'"],
    }


def test_scores(spark):
    m = "map<string,double>"
    df = spark.createDataFrame([({"completeness": 10.0, "format": 10.0, "x": 1.0},), ({"completeness": 10.0, "format": 9.0},), ({},)], f"s {m}")
    got = df.select(validation.average_score(F.col("s")), validation.extraction_passed(F.col("s")), validation.categorisation_passed(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(7.0, True, False), (9.5, False, False), (0.0, False, False)]
    judged = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "doc_id string, passed boolean")
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    assert {tuple(r) for r in validation.all_passed(judged, docs).collect()} == {("a", False), ("b", True), ("c", False)}


def test_merge(spark):
    one = rows(("x", ["1"], False))
    two = rows(("y", ["2"], False))
    pages = spark.createDataFrame(
        [("d", "cash_flow", 0, "bad", None, None), ("d", "cash_flow", 1, "base", ["a", "a"], [("A", one), ("A", [])]), ("d", "cash_flow", 2, "late", ["b", "a", "b"], [("A", two), ("B", one), ("B", two)])],
        "doc_id string, statement_type string, page_pos int, title string, periods array<string>, sections array<struct<name string, rows array<struct<label string, values array<string>, is_subtotal boolean>>>>",
    )
    m = S.merge_statements(pages).first()
    assert m.title == "base" and m.periods == ["a", "a", "b"]
    assert [(s.name, [r.label for r in s.rows]) for s in m.sections] == [("A", ["x", "y"]), ("A", ["y"]), ("B", ["x", "y"])]


def test_companies(spark):
    cells = spark.createDataFrame(
        [("c", "income_statement", 0, 0, "Revenue", "10"), ("c", "income_statement", 0, 1, " Total debt ", "3"), ("c", "income_statement", 0, 2, "Cash from operations", "4"), ("c", "balance_sheet", 0, 0, "Total debt", "9"), ("c", "balance_sheet", 0, 1, "Total assets", "50"), ("c", "cash_flow", 0, 0, "Cash from operations", "7")],
        "company string, statement_type string, section_pos int, row_pos int, label string, value_raw string",
    )
    got = {r.metric: r.value for r in S.company_metrics(cells).collect()}
    assert (got["revenue"], got["total_debt"], got["total_assets"], got["operating_cash_flow"]) == (10, 3, 50, 7)
    assert {r.metric: r.by_company for r in S.metric_maps(S.company_metrics(cells)).collect()}["revenue"] == {"c": 10.0}
    b = spark.createDataFrame([("a", 1, None, "2020"), ("a", 2, "2024", "2021"), ("b", 3, "", "2022")], "company string, seq int, given string, stated string")
    assert {(r.company, r.seq) for r in S.latest_companies(b).collect()} == {("a", 2), ("b", 3)}
    assert S.fiscal_year(b).first()[0] == "2024" and S.fiscal_year(b.where("seq <> 2")).first()[0] == "2020"


def chart(spark):
    return spark.createDataFrame([("5001", "Vaccine Revenue", "d" * 300, 0), ("5500", "Surgery Revenue", None, 1), ("5700", "Dentistry Revenue", "", 2), ("5701", "Dental Supplies", None, 3), ("7340", "Flea/Tick, Cost", None, 4)], "code string, name string, description string, pos int")


def test_accounts(spark):
    c = chart(spark)
    assert [r.code for r in accounts.in_section(c, "Cost of sales").orderBy("code").collect()] == ["5001", "5500", "5700", "5701"]
    assert accounts.in_section(c, "").count() == 5 and accounts.by_code(c, "1").count() == 0 and accounts.by_series(c, "5700").count() == 2
    assert [r.code for r in accounts.lookup(c, "DENT").collect()] == ["5700", "5701"]
    names = c.where("code = '7340'").select(accounts.aliases(F.col("name"))).first()[0]
    assert names == ["Flea", "Flea/Tick, Cost", "Tick", "Tick, Cost"]
    text = accounts.chart_text(c).first().text.split("\n\n")
    assert len(text) == 5 and text[0].split("\n")[1] == "5001 - Vaccine Revenue: " + "d" * 200 and text[1] == "Direct costs (accounts 6000 to 6999)"
    two = c.limit(1).unionByName(c.limit(1).withColumns({"name": F.lit("New"), "pos": F.lit(9)}))
    assert [(r.name, r.pos) for r in accounts.latest(two).collect()] == [("New", 0)]
    assert {r.alias: r.code for r in accounts.alias_index(c).collect()}["tick"] == "7340"


def test_match_details(spark):
    labels = spark.createDataFrame([("Surgery / Dentistry",), ("Dental",), ("Vaccinations",), ("Dental plaque",), ("Nothing",)], "label string")
    got = {r.label: r for r in matching.match(labels, chart(spark)).collect()}
    assert (got["Vaccinations"].code, got["Vaccinations"].confidence, got["Vaccinations"].matched_on) == ("5001", "high", ["vaccin"])
    assert (got["Dental"].code, got["Dental"].match_type) == ("5701", "exact_substring")
    assert got["Dental plaque"].match_type == "token_partial" and got["Dental plaque"].unmatched == ["plaqu"]
    assert got["Nothing"].confidence == "unmatched"
    twice = spark.createDataFrame([("Dentistry fees",)], "label string")
    r = matching.match(twice, chart(spark)).first()
    assert (r.code, r.confidence, r.alternatives) == ("5700", "ambiguous", ["5701"])
    assert [(r.part, r.code) for r in matching.compound_candidates(labels, chart(spark)).orderBy("part_pos").collect()] == [("Surgery", "5500"), ("Dentistry", "5700")]


def test_categorise(spark):
    docs = frame(spark, ("d", "income_statement", "P&L", ["2024"], [("REVENUE", rows(("Revenue", [], False), ("Vaccinations", ["5"], False), ("Odd", ["6", "7"], False), ("", ["1"], False), ("Total", ["11"], True))), ("COSTS", rows(("Rent", ["2"], False)))]), ("b", "balance_sheet", "B", [], []))
    income, other = review.gate(docs)
    assert (income.count(), other.count()) == (1, 1)
    answers = spark.createDataFrame([("Rent", 1, "7000", "Rent cost", "Operating", "high", "old", False, False), ("Rent", 2, "7001", "Rent", "Operating", "low", "new", False, True), ("Odd", 1, None, None, None, None, None, None, None)], "label string, seq int, account_id string, account_name string, category string, confidence string, reasoning string, needs_review boolean, is_split boolean")
    r = review.rows_of(income)
    m = matching.match(r.select("label"), chart(spark)).join(chart(spark).select("code", "name"), "code").withColumn("category", F.lit("Revenue"))
    out = review.categorise(r, answers, m)
    by = {x.label: x for x in out.collect()}
    assert (by["Revenue"].line_type, by["Revenue"].coa_code, by["Total"].match_type, by[""].match_type) == ("section_header", None, None, None)
    assert by["Vaccinations"].reasoning == "Token match on 'vaccin' → 5001 Vaccine Revenue" and not by["Vaccinations"].needs_review and by["Vaccinations"].citation == "VMG/AAHA CoA p.5000"
    assert (by["Rent"].coa_code, by["Rent"].match_type, by["Rent"].needs_review) == ("7001", "llm_split", True)
    assert (by["Odd"].match_type, by["Odd"].needs_review) == ("unmatched", True)
    assert {x.label for x in review.queue(out).collect()} == {"Odd", "Rent"}
    assert [(x.label, x.status) for x in review.samples(out, 3).orderBy("place").collect()] == [("Revenue", "section_header"), ("Vaccinations", "mapped"), ("Odd", "uncategorized")]
    s = review.summary(out).first()
    assert (s.total, s.headers, s.mapped, s.review, s.match_rate) == (4, 1, 2, 2, 0.667)
    items = S.line_items(income).withColumnRenamed("row_index", "row_pos")
    assert review.retry_items(items, out).count() == 2
    chosen = spark.createDataFrame([("d", 0, 2, "5500"), ("d", 1, 0, "7001")], "doc_id string, section_pos int, row_pos int, new_code string")
    assert [tuple(x) for x in review.corrections(review.queue(out), chosen, chart(spark)).collect()] == [("d", "Odd", "REVENUE", "None", "5500", "Surgery Revenue")]
    full = review.nested(out).join(income.select("doc_id", "title", "periods"), "doc_id")
    assert [[x.label for x in sec.rows] for sec in full.first().sections] == [["Revenue", "Vaccinations", "Odd", "", "Total"], ["Rent"]]
    cells = {(x.row_no, x.col_no): (x.value, x.style) for x in review.sheet(full).collect()}
    assert cells[1, 1] == ("P&L", "title") and cells[2, 3] == ("CoA Code", "header") and cells[3, 1] == ("REVENUE", "section")
    assert cells[5, 3] == ("5001", "plain") and cells[6, 9] == ("YES", "review") and cells[8, 2] == ("11", "subtotal") and (8, 3) not in cells and cells[10, 1][0] == "COSTS" and cells[11, 1][0] == "Rent"
    plain = {(x.row_no, x.col_no): x.value for x in review.sheet(income).collect()}
    assert max(c for _, c in plain) == 3 and plain[6, 3] == "7"
    shown = {x.label: x.figures for x in S.shown_rows(income).collect()}
    assert shown["Revenue"] == [""] and shown["Odd"] == ["6"]


def test_merged_pages_against_plain_lists(spark):
    """Pages without sections, failed pages, names twice on a page, null names and rows."""
    import random

    rng, rows = random.Random(1), []
    for d in range(40):
        for p in range(rng.randrange(1, 5)):
            one = lambda k: (rng.choice(["A", "B", "C", None]), None if rng.random() < 0.1 else [(f"l{d}{p}{k}{i}", ["1"], False) for i in range(rng.randrange(3))])
            rows.append((f"d{d}", "cash_flow", p * 2, f"t{p}", None if rng.random() < 0.2 else rng.sample(["1", "2", "3"], 2), None if rng.random() < 0.15 else [one(k) for k in range(rng.randrange(5))]))
    want = {}
    for d, _, _, title, periods, sections in rows:
        if sections is None:
            continue
        if d not in want:
            want[d] = (title, list(periods or []), [[n, r] for n, r in sections])
            continue
        _, known, merged = want[d]
        known += [x for x in periods or [] if x not in known]
        for n, r in sections:
            same = [m for m in merged if m[0] == n]
            for m in same:
                m[1] = (m[1] or []) + (r or [])
            if not same:
                merged.append([n, r])
    df = spark.createDataFrame(rows, "doc_id string, statement_type string, page_pos int, title string, periods array<string>, sections array<struct<name string, rows array<struct<label string, values array<string>, is_subtotal boolean>>>>")
    got = S.merge_statements(df).collect()
    plain = lambda rs: None if rs is None else [tuple(x) for x in rs]
    assert {r.doc_id: (r.title, r.periods, [[s.name, plain(s.rows)] for s in r.sections]) for r in got} == {d: (t, p, [[n, r] for n, r in s]) for d, (t, p, s) in want.items()}
