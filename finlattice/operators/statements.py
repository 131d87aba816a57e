"""Statements: cells, alias matching of metrics, ratios, totals, validation, page merge, sheet layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..functions.aliases import metrics_of

RATIOS = [("gross_margin", "gross_profit", "revenue", 100, 1), ("operating_margin", "operating_income", "revenue", 100, 1), ("net_margin", "net_income", "revenue", 100, 1), ("debt_to_equity", "total_debt", "total_equity", 1, 2), ("return_on_equity", "net_income", "total_equity", 100, 1), ("return_on_assets", "net_income", "total_assets", 100, 1)]


def flatten(statements: DataFrame) -> DataFrame:
    """Nested statements -> one row per label and period, with positions."""
    s = statements.select("*", F.posexplode("sections").alias("section_pos", "s"))
    r = s.select("*", F.posexplode("s.rows").alias("row_pos", "r"))
    v = r.select("*", F.posexplode_outer("r.values").alias("period_pos", "value_raw"))
    return v.select("doc_id", "statement_type", "section_pos", F.col("s.name").alias("section_name"), "row_pos", F.col("r.label").alias("label"), F.coalesce("r.is_subtotal", F.lit(False)).alias("is_subtotal"), "period_pos", F.get("periods", F.col("period_pos")).alias("period"), "value_raw", X.parse_value(F.col("value_raw")).alias("value_num"))


def line_items(statements: DataFrame) -> DataFrame:
    """Rows that aren't subtotals and have a label; row_index counts all rows of a section."""
    s = statements.select("doc_id", F.posexplode("sections").alias("section_pos", "s"))
    r = s.select("doc_id", "section_pos", F.col("s.name").alias("section"), F.posexplode("s.rows").alias("row_index", "r"))
    return r.where(~F.coalesce("r.is_subtotal", F.lit(False)) & (F.col("r.label") != "")).select("doc_id", "section_pos", "section", "row_index", "r.label", "r.values")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows in as many partitions as a shuffle has, by `key`; steps by this and other keys need no other exchange.

    For rows of which few can be combined: no task sorts those of a whole split or row group, nor of partitions that
    adaptive execution merges by their compressed size.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def metric_values(cells: DataFrame, *keys: str) -> DataFrame:
    """First row in document order whose label contains an alias of a metric, or is contained in it.

    cells: keys, section_pos, row_pos, label, value_raw of the first period. Labels go through an automaton of all aliases
    (functions.aliases), batch by batch: no label meets each alias. What was found is dealt out by the first key.
    """
    label = F.lower(X.strip(F.col("label")))
    hit = dealt(cells.where("value_raw is not null and value_raw <> ''").select(*keys, "section_pos", "row_pos", "value_raw", F.inline(metrics_of(label))), keys[0])
    first = hit.groupBy(*keys, "metric").agg(F.min_by("value_raw", F.struct("section_pos", "row_pos", "alias_pos")).alias("raw"))
    return first.select(*keys, "metric", X.parse_value(F.col("raw")).alias("value"))


def ratios(wide: DataFrame) -> DataFrame:
    """Adds the ratios; null where a part is missing or the base is 0 (a gross profit of 0 counts as missing)."""
    for name, top, base, scale, digits in RATIOS:
        if {top, base} <= set(wide.columns):
            ok = F.col(top).isNotNull() & F.col(base).isNotNull() & (F.col(base) != 0)
            if name == "gross_margin":
                ok = ok & (F.col(top) != 0)
            wide = wide.withColumn(name, F.when(ok, F.round(F.col(top) / F.col(base) * scale, digits)))
    return wide


def missing_ratio(cells: DataFrame, key: str) -> DataFrame:
    """Share of missing cells per key; 1.0 if it has none."""
    missing = F.col("value_raw").isNull() | F.col("value_raw").isin("", "null")
    return cells.groupBy(key).agg(F.round(F.coalesce(F.avg(F.when(F.col("row_pos").isNotNull(), missing.cast("int"))), F.lit(1.0)), 6).alias("missing_ratio"))


def section_totals(rows: DataFrame) -> DataFrame:
    """Last total row of each (doc, section) per period."""
    total = F.col("is_subtotal") | F.upper("label").contains("TOTAL")
    return rows.where(total & F.col("value_num").isNotNull()).groupBy("doc_id", "section", "period").agg(F.max_by("value_num", F.struct("row_pos", "value_num")).alias("total"))


def balance_check(rows: DataFrame) -> DataFrame:
    """assets against liabilities + equity, within 1 % of assets or 1000."""
    diff = F.abs(F.col("assets") - (F.col("liabilities") + F.col("equity")))
    return rows.withColumn("difference", diff).withColumn("balanced", ~(diff > F.greatest(F.abs("assets") * F.lit(0.01), F.lit(1000.0))))


def merge_pages(rows: DataFrame) -> DataFrame:
    """Rows of a document's pages by section, in page order; sections in the order of their first page."""
    merged = rows.groupBy("doc_id", "section").agg(F.min("page").alias("first_page"), F.array_sort(F.collect_list(F.struct("page", "row_pos", "label"))).alias("r"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_page", "section"))
    return merged.select("doc_id", order.cast("int").alias("section_no"), "section", F.array_join(F.col("r.label"), "|").alias("labels"), F.size("r").cast("int").alias("n_rows"))


def sheet_cells(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Cells of a sheet per key: title in row 1, header in row 2, then a row per input row."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order)) + 2
    rows = rows.withColumn("row_no", number)
    body = rows.select(key, "row_no", F.posexplode(F.array(*(F.col(c).cast("string") for c in columns))).alias("col", "value"))
    head = rows.select(key).distinct().select(key, F.lit(2).alias("row_no"), F.posexplode(F.array(*(F.lit(c) for c in columns))).alias("col", "value"))
    return body.unionByName(head).select(key, F.col("row_no").cast("int").alias("row_no"), (F.col("col") + 1).cast("int").alias("col_no"), F.coalesce("value", F.lit("")).alias("value"))


def income_check(rows: DataFrame) -> DataFrame:
    """gross_gap: gross profit is off revenue - cost by over 5 % of revenue and 10000; odd_margin: |net / revenue| > 1.

    A missing figure raises no flag; neither does a revenue of 0 or less the second one.
    """
    gap = F.abs(F.col("gross_profit") - (F.col("revenue") - F.col("cost"))) > F.greatest(F.abs("revenue") * F.lit(0.05), F.lit(10000.0))
    odd = (F.col("revenue") > 0) & (F.abs("net_income") > F.col("revenue"))
    return rows.withColumn("gross_gap", F.coalesce(gap, F.lit(False))).withColumn("odd_margin", F.coalesce(odd, F.lit(False)))


def valid_pages(answers: DataFrame) -> DataFrame:
    """doc_id, pages: the whole numbers from 1 to total_pages in the JSON list `answer`, as they come; no list: none.

    Fractions, strings and flags aren't pages.
    """
    listed = page_list("answer", "total_pages")
    return answers.select("doc_id", listed.alias("pages"))


def page_list(answer: str, total: str):
    """valid_pages() of the columns so named."""
    kept = F.expr(f"filter(try_variant_get(try_parse_json({answer}), '$', 'array<variant>'), x -> schema_of_variant(x) = 'BIGINT' and try_variant_get(x, '$', 'bigint') between 1 and {total})")
    return F.coalesce(F.transform(kept, lambda x: F.try_variant_get(x, "$", "int")), F.array().cast("array<int>"))


def page_marks(documents: DataFrame, page_map: DataFrame) -> DataFrame:
    """doc_id, page_num, shown of every page from 1 to total_pages; the pages of the map are ticked."""
    every = documents.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("total_pages").cast("int"))).alias("page_num"))
    ticked = page_map.select("doc_id", F.col("page_num").cast("int").alias("page_num")).distinct().withColumn("tick", F.lit(" ✓"))
    return every.join(ticked, ["doc_id", "page_num"], "left").select("doc_id", "page_num", F.concat(F.lit("Page "), "page_num", F.coalesce("tick", F.lit(""))).alias("shown"))


def company_metrics(cells: DataFrame) -> DataFrame:
    """company, metric, value of cells (company, statement_type, section_pos, row_pos, label, value_raw of the first period).

    Income statements speak for every metric, balance sheets for their own where the former don't, cash flows over both for theirs.
    """
    kind = F.col("statement_type")
    rank = F.when(kind == "income_statement", 1).when((kind == "balance_sheet") & F.col("metric").isin(V.BALANCE_METRICS), 2).when((kind == "cash_flow") & F.col("metric").isin(V.CASH_METRICS), 0)
    ranked = metric_values(cells, "company", "statement_type").where("value is not null").withColumn("rank", rank).where("rank is not null")
    return ranked.groupBy("company", "metric").agg(F.min_by("value", "rank").alias("value"))


def latest_companies(bundles: DataFrame) -> DataFrame:
    """One bundle per company name, the last added (by seq)."""
    names = [c for c in bundles.columns if c != "company"]
    g = bundles.groupBy("company").agg(F.max_by(F.struct(*names), "seq").alias("b"))
    return g.select("company", *(F.col("b")[c].alias(c) for c in names))


def fiscal_year(bundles: DataFrame) -> DataFrame:
    """One row: the last year given for the comparison (`given`), else the first that a bundle states (`stated`)."""
    last, first = F.max_by("given", F.when(F.col("given") != "", F.col("seq"))), F.min_by("stated", F.when(F.col("stated") != "", F.col("seq")))
    return bundles.agg(F.coalesce(last, first).alias("fiscal_year"))


def metric_maps(values: DataFrame) -> DataFrame:
    """metric, by_company: a map of the companies that have the metric."""
    return values.groupBy("metric").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("company", "value")))).alias("by_company"))


def union_periods(base, new):
    """Periods of `base` as they are, then those of `new` that it lacks, each once."""
    return F.concat(base, F.array_distinct(F.filter(new, lambda x: ~F.array_contains(base, x))))


def merge_statements(pages: DataFrame) -> DataFrame:
    """doc_id, statement_type and the merged title, periods and sections of a statement's pages, in order of page_pos.

    The first page that has sections is the base. A later page's section goes to every section of its name, else to the
    end; values aren't moved to other periods. Pages that failed (null sections) take no part.
    """
    key, rows_type = ["doc_id", "statement_type"], "array<struct<label:string,values:array<string>,is_subtotal:boolean>>"
    none, no_periods = F.array().cast(rows_type), F.array().cast("array<string>")
    ok = pages.where("sections is not null").repartition(*key)  # the steps below need no other exchange
    page = F.struct("page_pos", "title", F.coalesce("periods", no_periods).alias("periods"))
    g = ok.groupBy(*key).agg(F.array_sort(F.collect_list(page)).alias("p"))
    first, rest = F.col("p")[0], F.slice("p", 2, F.size("p"))
    periods = F.aggregate(F.transform(rest, lambda q: q["periods"]), first["periods"], union_periods)
    heads = g.select(*key, first["title"].alias("title"), periods.alias("periods"))
    base = F.col("page_pos") == F.min("page_pos").over(Window.partitionBy(*key))
    s = ok.select(*key, "page_pos", "sections", base.alias("base"))  # a step of its own: a page without sections may be the base
    s = s.select(*key, "page_pos", "base", F.posexplode("sections").alias("at", "s"))
    s = s.select(*key, "base", F.struct("page_pos", "at").alias("place"), F.col("s.name").alias("name"), F.col("s.rows").cast(rows_type).alias("rows"))
    # all sections of one name: the base page's, and what later pages add to each of them, or else to the first of their own
    one = F.array_sort(F.collect_list(F.when(F.col("base"), F.struct("place", "rows"))))
    more = F.array_sort(F.collect_list(F.when(~F.col("base"), F.struct("place", "rows"))))
    n = s.groupBy(*key, "name").agg(one.alias("own"), more.alias("more"))
    targets = F.when(F.size("own") > 0, F.col("own")).otherwise(F.slice("more", 1, 1))
    added = F.when(F.size("own") > 0, F.col("more")).otherwise(F.slice("more", 2, F.greatest(F.size("more"), F.lit(1))))
    n = n.select(*key, "name", F.explode(targets).alias("t"), F.flatten(F.transform(added, lambda x: F.coalesce(x["rows"], none))).alias("added"), (F.size(added) > 0).alias("grown"))
    section = F.struct(F.col("t.place").alias("place"), "name", F.when(F.col("grown"), F.concat(F.coalesce("t.rows", none), "added")).otherwise(F.col("t.rows")).alias("rows"))
    merged = n.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(section), lambda x, y: F.when(x["place"] < y["place"], -1).otherwise(1)), lambda x: x.dropFields("place")).alias("sections"))
    empty = F.array().cast(f"array<struct<name:string,rows:{rows_type}>>")
    return heads.join(merged, key, "left").select(*key, "title", "periods", F.coalesce("sections", empty).alias("sections"))


def shown_rows(statements: DataFrame) -> DataFrame:
    """doc_id, section, label and one text per period ("" where a row has none; figures beyond the periods don't show)."""
    s = statements.select("doc_id", "periods", F.posexplode("sections").alias("section_pos", "s"))
    r = s.select("doc_id", "periods", "section_pos", F.col("s.name").alias("section"), F.posexplode("s.rows").alias("row_pos", "r"))
    figures = F.transform("periods", lambda p, i: F.coalesce(F.get("r.values", i), F.lit("")))
    return r.select("doc_id", "section_pos", "section", "row_pos", F.col("r.label").alias("label"), figures.alias("figures"))
