"""Categorised rows: assignment, re-nesting, samples, the review queue, corrections made in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V

CATEGORY = ["coa_code", "coa_name", "coa_category", "match_type", "confidence", "reasoning", "needs_review", "citation", "is_split"]
ANSWER = ["account_id", "account_name", "category", "confidence", "reasoning", "needs_review", "is_split"]


def rows_of(statements: DataFrame) -> DataFrame:
    """Every row of a statement with its place, subtotals too."""
    s = statements.select("doc_id", "statement_type", F.posexplode("sections").alias("section_pos", "s"))
    r = s.select("doc_id", "statement_type", "section_pos", F.col("s.name").alias("section"), F.posexplode("s.rows").alias("row_pos", "r"))
    return r.select("doc_id", "statement_type", "section_pos", "section", "row_pos", F.col("r.label").alias("label"), F.col("r.values").alias("values"), F.coalesce("r.is_subtotal", F.lit(False)).alias("is_subtotal"))


def postable(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Section headers, and the items that can be posted."""
    head = F.coalesce(X.is_section_header(F.col("label")), F.lit(False))
    return items.where(head), items.where(~head)


def answered(answers: DataFrame) -> DataFrame:
    """One record per label (and document, if answers have doc_id), the last by seq with an account; error records have none."""
    key = answer_key(answers)
    cols = [c for c in answers.columns if c not in (*key, "seq")]
    g = answers.where("account_id is not null").groupBy(*key).agg(F.max_by(F.struct(*cols), "seq").alias("r"))
    return g.select(*key, *(F.col("r")[c].alias(c) for c in cols))


def answer_key(answers: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "label") if c in answers.columns]


def with_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows with what was answered for their label, in columns a_*."""
    key = answer_key(answers)
    return rows.join(answered(answers).select(*key, *(F.col(c).alias(f"a_{c}") for c in ANSWER)), key, "left")


def reason(kind: Column, code: Column, name: Column, matched_on: Column) -> Column:
    to = F.concat(F.lit(" → "), code, F.lit(" "), name)
    words = F.when(F.size(matched_on) > 0, F.array_join(matched_on, ", ")).otherwise("unknown token")
    told = F.when(kind == "exact", "Exact name match").when(kind == "exact_substring", F.concat(F.lit("Substring match ('"), F.get(matched_on, F.lit(0)), F.lit("')")))
    return F.concat(told.otherwise(F.concat(F.lit("Token match on '"), words, F.lit("'"))), to)


def categorise(rows: DataFrame, answers: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """Rows with line_type and the columns of CATEGORY.

    answers: label, seq, account_id, account_name, category, confidence, reasoning, needs_review, is_split; the last per
    label counts. matched (label, code, name, category, match_type, confidence, matched_on) goes before them. Rows that
    neither knows need review. Subtotals and empty labels have no category; headers have one without an account.
    """
    j = with_answers(rows, answers)
    if matched is None:
        j = j.withColumns({f"m_{c}": F.lit(None).cast(k) for c, k in (("code", "string"), ("name", "string"), ("category", "string"), ("match_type", "string"), ("confidence", "string"), ("matched_on", "array<string>"))})
    else:
        m = matched.where("code is not null").select("label", *(F.col(c).alias(f"m_{c}") for c in ("code", "name", "category", "match_type", "confidence", "matched_on")))
        j = j.join(m, "label", "left")
    header = F.coalesce(X.is_section_header(F.col("label")), F.lit(False))
    open_row = ~F.col("is_subtotal") & (F.coalesce("label", F.lit("")) != "")
    split = F.coalesce("a_is_split", F.lit(False))

    def pick(head, match, answer, none):
        return F.when(open_row, F.when(header, head).when(F.col("m_code").isNotNull(), match).when(F.col("a_account_id").isNotNull(), answer).otherwise(none))

    null, no, yes, empty = F.lit(None).cast("string"), F.lit(False), F.lit(True), F.lit("")
    sure = F.coalesce("a_confidence", F.lit("low"))
    out = {
        "line_type": F.when(open_row & header, "section_header"),
        "coa_code": pick(null, F.col("m_code"), F.col("a_account_id"), null),
        "coa_name": pick(null, F.col("m_name"), F.coalesce("a_account_name", empty), null),
        "coa_category": pick(null, F.col("m_category"), F.coalesce("a_category", empty), null),
        "match_type": pick(F.lit("section_header"), F.col("m_match_type"), F.when(split, "llm_split").otherwise("llm"), F.lit("unmatched")),
        "confidence": pick(F.lit("high"), F.col("m_confidence"), sure, F.lit("unmatched")),
        "reasoning": pick(F.lit("Structural label without an account"), reason(F.col("m_match_type"), F.col("m_code"), F.col("m_name"), F.col("m_matched_on")), F.coalesce("a_reasoning", empty), F.lit("No account found; needs a person")),
        "needs_review": pick(no, F.col("m_confidence") != "high", (sure == "low") | F.coalesce("a_needs_review", no), yes),
        "citation": pick(null, F.concat(F.lit("VMG/AAHA CoA p."), X.series_of(F.col("m_code"))), F.lit("VMG/AAHA DATALINK Definitions"), F.lit("N/A - needs human review")),
        "is_split": pick(no, no, split, no),
    }
    return j.select(*rows.columns, *(c.alias(n) for n, c in out.items()))


def merge_retry(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows that need review take the new answer for their label, if there is one; all others stay as they are."""
    j = with_answers(rows, answers)
    use = F.coalesce("needs_review", F.lit(False)) & F.col("a_account_id").isNotNull()
    split, sure, empty = F.coalesce("a_is_split", F.lit(False)), F.coalesce("a_confidence", F.lit("low")), F.lit("")
    new = {"coa_code": F.col("a_account_id"), "coa_name": F.coalesce("a_account_name", empty), "coa_category": F.coalesce("a_category", empty), "match_type": F.when(split, "llm_split").otherwise("llm_retry"), "confidence": sure, "reasoning": F.coalesce("a_reasoning", empty), "needs_review": (sure == "low") | F.coalesce("a_needs_review", F.lit(False)), "citation": F.lit("VMG/AAHA DATALINK Definitions (retry)"), "is_split": split}
    return j.select(*(F.when(use, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns))


def gate(statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Income statements, which are categorised, and the others, which pass as they are."""
    income = F.col("statement_type") == "income_statement"
    return statements.where(income), statements.where(~F.coalesce(income, F.lit(False)))


def nested(rows: DataFrame) -> DataFrame:
    """Categorised rows as sections again: doc_id, statement_type, sections. Sections without rows are gone."""
    row = F.struct("row_pos", "label", "values", "is_subtotal", "line_type", F.struct(*CATEGORY).alias("categorization"))
    s = rows.groupBy("doc_id", "statement_type", "section_pos", "section").agg(F.array_sort(F.collect_list(row)).alias("r"))
    section = F.struct("section_pos", F.col("section").alias("name"), F.transform("r", lambda x: x.dropFields("row_pos")).alias("rows"))
    g = s.groupBy("doc_id", "statement_type").agg(F.array_sort(F.collect_list(section)).alias("s"))
    return g.select("doc_id", "statement_type", F.transform("s", lambda x: x.dropFields("section_pos")).alias("sections"))


def samples(rows: DataFrame, limit: int = 50) -> DataFrame:
    """The first `limit` rows of each document that say something: mapped ones, headers, rows without an account."""
    status = F.when(F.coalesce("coa_code", F.lit("")) != "", "mapped").when(F.col("line_type") == "section_header", "section_header").when(~F.col("is_subtotal") & F.col("line_type").isNull(), "uncategorized")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_pos", "row_pos"))
    s = rows.withColumn("status", status).where("status is not null").withColumn("place", place)
    return s.where(F.col("place") <= limit).select("doc_id", "place", "label", "section", "coa_code", "status")


def queue(rows: DataFrame) -> DataFrame:
    """Rows that a person should look at: flagged, or of low or no confidence."""
    return rows.where(F.coalesce("needs_review", F.lit(False)) | F.col("confidence").isin("low", "unmatched"))


def retry_items(items: DataFrame, rows: DataFrame) -> DataFrame:
    """Items whose label's last category needs review."""
    return items.join(rows.where("needs_review").select("doc_id", "label").distinct(), ["doc_id", "label"], "left_semi")


def first_sections(items: DataFrame) -> DataFrame:
    """doc_id, label -> the section of the label's first item."""
    return items.groupBy("doc_id", "label").agg(F.min_by("section", F.struct("section_pos", "row_pos")).alias("section"))


def corrections(queued: DataFrame, chosen: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows whose chosen code isn't the old one, named by the chart ("" if it doesn't know the code). No old code is "None"."""
    old = F.coalesce("coa_code", F.lit("None"))
    j = queued.join(chosen.select("doc_id", "section_pos", "row_pos", "new_code"), ["doc_id", "section_pos", "row_pos"]).where((F.col("new_code") != "") & (F.col("new_code") != old))
    named = j.join(accounts.select(F.col("code").alias("new_code"), F.col("name").alias("new_name")), "new_code", "left")
    return named.select("doc_id", "label", "section", old.alias("wrong_code"), F.col("new_code").alias("correct_code"), F.coalesce("new_name", F.lit("")).alias("correct_name"))


def summary(rows: DataFrame) -> DataFrame:
    """doc_id, total, headers, mapped, review, match_rate over rows that have a category."""
    g = rows.where("match_type is not null").groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(F.col("line_type") == "section_header").alias("headers"), F.count_if(F.col("coa_code").isNotNull()).alias("mapped"), F.count_if("needs_review").alias("review"))
    return g.withColumn("match_rate", F.round(F.coalesce(F.try_divide(F.col("mapped"), F.col("total") - F.col("headers")), F.lit(0.0)), 3))


def sheet(statements: DataFrame) -> DataFrame:
    """doc_id, row_no, col_no, value, style of a statement's sheet.

    Row 1 holds the title, row 2 the header, then each section's name, its rows and a blank row. With categories
    (statements of nested()), eight columns follow the periods. Styles: title, header, section, subtotal, review, low, plain.
    """
    has = "categorization" in statements.schema["sections"].dataType.elementType["rows"].dataType.elementType.fieldNames()
    s = statements.select("doc_id", "title", "periods", F.posexplode("sections").alias("sp", "s"))
    sizes = F.sum(F.size("s.rows") + 2).over(Window.partitionBy("doc_id").orderBy("sp").rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("at", F.coalesce(sizes, F.lit(0)) + 3)
    cell = lambda col, value, style: F.struct(F.lit(col).cast("int").alias("col_no") if isinstance(col, int) else col.cast("int").alias("col_no"), value.cast("string").alias("value"), style.alias("style"))
    names = s.select("doc_id", F.col("at").alias("row_no"), F.array(cell(1, F.col("s.name"), F.lit("section"))).alias("cells"))
    r = s.select("doc_id", "periods", "at", F.posexplode("s.rows").alias("rp", "r"))
    base = F.when(F.coalesce("r.is_subtotal", F.lit(False)), "subtotal").otherwise("plain")
    cells = F.concat(F.array(cell(1, F.col("r.label"), base)), F.transform(F.coalesce("r.values", F.array().cast("array<string>")), lambda v, i: cell(i + 2, v, base)))
    if has:
        c = lambda k: F.col(f"r.categorization.{k}")
        flagged = F.coalesce(c("needs_review"), F.lit(False))
        style = F.when((c("match_type") == "unmatched") | flagged, "review").when(c("confidence").isin("low", "unmatched") & (c("match_type") != "section_header"), "low").otherwise("plain")
        values = [*(F.coalesce(c(k), F.lit("")) for k in CATEGORY[:6]), F.when(flagged, "YES").otherwise("No"), F.coalesce(c("citation"), F.lit(""))]
        extra = F.array(*(cell(F.size("periods") + 2 + i, v, style) for i, v in enumerate(values)))
        cells = F.when(base == "subtotal", cells).otherwise(F.concat(cells, extra))
    body = r.select("doc_id", (F.col("at") + 1 + F.col("rp")).alias("row_no"), cells.alias("cells"))
    heads = F.concat(F.array(F.lit("Line Item")), F.col("periods"), F.array(*map(F.lit, V.REVIEW_COLUMNS if has else [])).cast("array<string>"))
    top = statements.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("row_no"), F.array(cell(1, F.coalesce("title", F.lit("Financial Statement")), F.lit("title"))).alias("cells")), F.struct(F.lit(2).alias("row_no"), F.transform(heads, lambda h, i: cell(i + 1, h, F.lit("header"))).alias("cells")))).alias("x")).select("doc_id", "x.*")
    every = top.unionByName(names).unionByName(body)
    return every.select("doc_id", F.col("row_no").cast("int").alias("row_no"), F.inline("cells"))


