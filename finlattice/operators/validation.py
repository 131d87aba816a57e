"""Checks of statements as tables of findings: doc_id, period_pos, check, level, amount, against.

Cells are what statements.flatten() returns. A finding of level `error` makes a statement invalid, a `warning` doesn't.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from .statements import dealt

_FINDING = ["doc_id", "period_pos", "check", "level", "amount", "against"]


def role_totals(cells: DataFrame) -> DataFrame:
    """doc_id, period_pos, assets, liabilities, equity: the totals that the accounting equation compares.

    A section's total is its last total row; sections of one name (case aside) count as one, told by the last of
    them that has a total, in the place of the first. The last section of a role speaks for it: where that has no
    total for a period, the role has none.
    """
    name = F.upper("section_name")
    total = (F.col("is_subtotal") | F.upper("label").contains("TOTAL")) & F.col("value_num").isNotNull()
    role = F.when(F.col("name").contains("ASSET"), "assets").when(F.col("name").contains("LIAB"), "liabilities").when(F.col("name").contains("EQUITY") | F.col("name").contains("STOCKHOLDER"), "equity")
    t = dealt(cells.where(total).select("doc_id", name.alias("name"), "section_pos", "period_pos", "row_pos", "value_num").where(role.isNotNull()), "doc_id")
    t = t.groupBy("doc_id", "name", "section_pos", "period_pos").agg(F.max_by("value_num", "row_pos").alias("total"))
    same = Window.partitionBy("doc_id", "name")
    t = t.withColumn("first", F.min("section_pos").over(same)).withColumn("last", F.max("section_pos").over(same)).where("section_pos = last").withColumn("role", role)
    t = t.withColumn("top", F.max("first").over(Window.partitionBy("doc_id", "role"))).where("first = top")
    return t.groupBy("doc_id", "period_pos").pivot("role", ["assets", "liabilities", "equity"]).agg(F.first("total"))


def _findings(rows: DataFrame, check: str, level: str, amount: Column, against: Column) -> DataFrame:
    return rows.select("doc_id", "period_pos", F.lit(check).alias("check"), F.lit(level).alias("level"), amount.cast("double").alias("amount"), against.cast("double").alias("against"))


def balance_findings(cells: DataFrame) -> DataFrame:
    """Assets off liabilities and equity by over 1 % of them and 1000 (errors); negative assets (warnings).

    Labels with `accumulated` or `depreciation` may be negative. A period without all three totals isn't compared.
    """
    both = F.col("liabilities") + F.col("equity")
    off = role_totals(cells).where(F.abs(F.col("assets") - both) > F.greatest(F.abs("assets") * F.lit(0.01), F.lit(1000.0)))
    negative = cells.where(F.upper("section_name").contains("ASSET") & (F.col("value_num") < 0) & ~F.lower("label").rlike("accumulated|depreciation"))
    return _findings(off, "unbalanced", "error", F.col("assets"), both).unionByName(_findings(negative, "negative_asset", "warning", F.col("value_num"), F.lit(0.0)))


def _last_values(cells: DataFrame, metric: Column) -> DataFrame:
    m = cells.where("value_num is not null").select("doc_id", "period_pos", metric.alias("metric"), "section_pos", "row_pos", "value_num").where("metric is not null")
    return dealt(m, "doc_id").groupBy("doc_id", "period_pos", "metric").agg(F.max_by("value_num", F.struct("section_pos", "row_pos")).alias("v"))


def income_findings(cells: DataFrame) -> DataFrame:
    """Gross profit off revenue - cost by over 5 % of revenue and 10000; net income over revenue. The last row of a metric counts.

    Costs are told before revenue, for their labels may hold its words.
    """
    label, has = F.lower("label"), lambda p: F.lower("label").rlike(p)
    metric = F.when(has("cost of revenue|cost of sales"), "cost").when(has("revenue|sales|turnover"), "revenue").when(has("gross profit"), "gross").when(label.rlike("net income|net profit"), "net")
    w = _last_values(cells, metric).groupBy("doc_id", "period_pos").pivot("metric", ["cost", "revenue", "gross", "net"]).agg(F.first("v"))
    margin = F.col("revenue") - F.col("cost")
    gap = w.where(F.abs(F.col("gross") - margin) > F.greatest(F.abs("revenue") * F.lit(0.05), F.lit(10000.0)))
    odd = w.where((F.col("revenue") > 0) & (F.abs("net") > F.col("revenue")))
    return _findings(gap, "gross_gap", "warning", F.col("gross"), margin).unionByName(_findings(odd, "odd_margin", "warning", F.col("net"), F.col("revenue")))


def cash_findings(cells: DataFrame) -> DataFrame:
    """A negative cash subtotal of an operating section, the last one counts."""
    of_operations = F.lower("section_name").contains("operating") & F.lower("label").contains("cash") & F.col("is_subtotal")
    low = _last_values(cells, F.when(of_operations, "cash")).where("v < 0")
    return _findings(low, "negative_operating_cash", "warning", F.col("v"), F.lit(0.0))


CHECKS = {"balance_sheet": balance_findings, "income_statement": income_findings, "cash_flow": cash_findings}


def findings(cells: DataFrame, compat: bool = False) -> DataFrame:
    """All findings, each statement by the checks of its type; `compat` has those of balance sheets alone, as it once was."""
    kinds = ["balance_sheet"] if compat else list(CHECKS)
    return reduce(DataFrame.unionByName, (CHECKS[k](cells.where(F.col("statement_type") == k)).withColumn("statement_type", F.lit(k)) for k in kinds))


def verdicts(statements: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, statement_type, valid, errors, warnings; types without checks are valid."""
    key = ["doc_id", "statement_type"]
    n = found.groupBy(*key).agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    out = statements.select(*key).distinct().join(n, key, "left").na.fill(0, ["errors", "warnings"])
    return out.select(*key, (F.col("errors") == 0).alias("valid"), "errors", "warnings")


def missing_sections(statements: DataFrame) -> DataFrame:
    """doc_id, statement_type, missing: required words that no section name holds, in their order; types without any: none."""
    words = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in V.REQUIRED_SECTIONS.items() for x in kv))
    names = F.transform("sections", lambda s: F.upper(s["name"]))
    wanted = F.coalesce(F.try_element_at(words, F.col("statement_type")), F.array().cast("array<string>"))
    s = statements.select("doc_id", "statement_type", wanted.alias("w"), F.coalesce(names, F.array().cast("array<string>")).alias("n"))
    gone = F.filter("w", lambda w: ~F.exists("n", lambda n: F.coalesce(n.contains(w), F.lit(False))))
    return s.select("doc_id", "statement_type", gone.alias("missing"))


def structure_errors(texts: DataFrame) -> DataFrame:
    """doc_id, errors: what is wrong with the shape of a statement's JSON `text`, in order; none is an empty list.

    Top-level keys come first, and alone if one is missing. Text that isn't a JSON object lacks all of them.
    A key with a null counts as there.
    """
    none = F.array().cast("array<string>")
    keys = lambda v: f"coalesce(map_keys(try_variant_get({v}, '$', 'map<string,variant>')), array())"
    items = lambda v, k: f"try_variant_get({v}, '$.{k}', 'array<variant>')"
    d = texts.select("doc_id", F.expr("try_parse_json(text)").alias("v"))
    d = d.select("doc_id", F.expr(keys("v")).alias("keys"), F.expr(items("v", "periods")).alias("periods"), F.expr(items("v", "sections")).alias("sections"))
    top = F.array_compact(F.array(*(F.when(~F.array_contains("keys", k), f"Missing required key: {k}") for k in ("title", "periods", "sections"))))
    row = f"array_compact(array(case when not array_contains({keys('r')}, 'label') then concat('Section ', i, ', row ', j, ' missing ''label''') end, case when not array_contains({keys('r')}, 'values') then concat('Section ', i, ', row ', j, ' missing ''values''') end))"
    rows = f"case when not array_contains({keys('s')}, 'rows') then array(concat('Section ', i, ' missing ''rows'' field')) when {items('s', 'rows')} is null then array(concat('Section ', i, ' ''rows'' must be a list')) else flatten(transform({items('s', 'rows')}, (r, j) -> {row})) end"
    each = f"flatten(transform(sections, (s, i) -> concat(case when array_contains({keys('s')}, 'name') then cast(array() as array<string>) else array(concat('Section ', i, ' missing ''name'' field')) end, {rows})))"
    listed = lambda c, m: F.when(F.col(c).isNull() | (F.size(c) == 0), F.array(F.lit(m))).otherwise(none)
    inner = F.concat(listed("periods", "Periods must be a non-empty list"), listed("sections", "Sections must be a non-empty list"), F.coalesce(F.expr(each), none))
    return d.select("doc_id", F.when(F.size(top) > 0, top).otherwise(inner).alias("errors"))


def average_score(scores: Column) -> Column:
    """Mean of a map of scores; 0 for an empty one."""
    return F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(scores), F.lit(1))


def extraction_passed(scores: Column) -> Column:
    """completeness and format are full and the mean is 7 or more."""
    full = lambda k: F.coalesce(F.try_element_at(scores, F.lit(k)) == 10, F.lit(False))
    return full("completeness") & full("format") & (average_score(scores) >= 7)


def categorisation_passed(scores: Column) -> Column:
    """coverage 7, format 10, sanity 5, learned 10 at least, and a mean of 6."""
    at_least = lambda k, n: F.coalesce(F.try_element_at(scores, F.lit(k)) >= n, F.lit(False))
    return at_least("coverage", 7) & at_least("format", 10) & at_least("sanity", 5) & at_least("learned", 10) & (average_score(scores) >= 6)


def all_passed(judged: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, passed: whether all of a document's statements passed; False without any."""
    g = judged.groupBy("doc_id").agg(F.bool_and("passed").alias("passed"))
    return documents.select("doc_id").distinct().join(g, "doc_id", "left").na.fill(False, ["passed"])
