"""From pages to categorised statements: detect, extract, judge, categorise, judge again, with bounded retries.

Each stage is a DataFrame; a stage that asks a model writes its answers (flow.keep), so a lost executor or a second
use asks nothing again. Models come in as providers.Ask functions; their prompts are made here.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import accounts as A
from ..operators import memory, review, telemetry, validation
from ..operators import statements as S
from . import providers
from .flow import Flow
from .tables import small

TYPES = ["balance_sheet", "income_statement", "cash_flow"]
SECTIONS = "array<struct<name string, rows array<struct<label string, values array<string>, is_subtotal boolean>>>>"
STATEMENT = f"title string, periods array<string>, sections {SECTIONS}"
RECORD = "label string, account_id string, account_name string, category string, confidence string, reasoning string, needs_review boolean, is_split boolean"
VERDICT = "scores map<string,double>, passed boolean, feedback string"
ATTEMPTS = 2


def statement_types(text: str | None) -> list[str]:
    """Comma-separated names of types, as they come; unknown ones are left out, `all` or none at all is every type."""
    out = []
    for name in (text or "").split(","):
        name = name.strip().lower()
        out += TYPES if name == "all" else [name] if name in TYPES else []
    return out or list(TYPES)


def types_of(text: Column) -> Column:
    """statement_types() of a column."""
    names = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    every = F.array(*map(F.lit, TYPES))
    listed = F.flatten(F.transform(names, lambda x: F.when(x == "all", every).when(F.array_contains(every, x), F.array(x)).otherwise(F.array().cast("array<string>"))))
    return F.when(F.size(listed) == 0, every).otherwise(listed)


def has_text(pages: DataFrame) -> DataFrame:
    """doc_id, total_pages, has_text: over 100 characters on all pages together."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"), (F.coalesce(F.sum(F.length("text")), F.lit(0)) > 100).alias("has_text"))


def previews(pages: DataFrame) -> DataFrame:
    """doc_id, preview: the first 500 characters of each page, in order."""
    body = F.when(F.coalesce("text", F.lit("")) == "", "[No text extracted]").otherwise(F.substring("text", 1, 500))
    line = F.concat(F.lit("Page "), F.col("page_num").cast("string"), F.lit(":\n"), body)
    g = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_num", line.alias("line"))))["line"].alias("p"))
    return g.select("doc_id", F.array_join("p", "\n\n---\n\n").alias("preview"))


def detect(pages: DataFrame, ask: providers.Ask, types: list[str] = TYPES, flow: Flow = Flow()) -> DataFrame:
    """doc_id, statement_type, page_pos, page_num of pages (doc_id, page_num, text, perhaps image).

    Documents with a text layer are asked about once, by previews; of the others every page is shown as an image.
    Answers that can't be read name no page.
    """
    kinds = has_text(pages)
    shown = previews(pages).join(kinds.where("has_text"), "doc_id")
    names = ", ".join(types)
    told = F.concat(F.lit(f"Which pages hold these statements: {names}? Answer with a JSON object of lists of page numbers.\n\n"), F.col("preview"))
    texts = flow.ask(shown.select("doc_id", "total_pages", told.alias("prompt")), ask, "detect-text")
    found = texts.withColumn("body", X.first_object(X.model_text(F.col("answer")))).select("doc_id", "total_pages", F.inline(F.array(*(F.struct(F.lit(t).alias("statement_type"), F.get_json_object("body", f"$.{t}").alias("listed")) for t in types))))
    by_text = found.select("doc_id", "statement_type", F.posexplode(S.page_list("listed", "total_pages")).alias("page_pos", "page_num"))
    if "image" not in pages.columns:
        return by_text
    flags = page_flags(pages.join(kinds.where("not has_text"), "doc_id", "left_semi"), ask, types, flow).where("flag")
    place = (F.row_number().over(Window.partitionBy("doc_id", "statement_type").orderBy("page_num")) - 1).alias("page_pos")
    return by_text.unionByName(flags.select("doc_id", "statement_type", place, F.col("page_num").cast("int").alias("page_num")))


def page_flags(pages: DataFrame, ask: providers.Ask, types: list[str] = TYPES, flow: Flow = Flow()) -> DataFrame:
    """doc_id, page_num, statement_type, flag: what the image of each page is said to hold, all types in one call; unread answers: nothing."""
    asked = pages.where("image is not null").select("doc_id", "page_num", "image", F.lit(f"Does this page hold one of these statements: {', '.join(types)}? Answer with a JSON object of true or false.").alias("prompt"))
    seen = flow.ask(asked, ask, "detect-image").withColumn("body", X.first_object(X.model_text(F.col("answer"))))
    return seen.select("doc_id", "page_num", F.inline(F.array(*(F.struct(F.lit(t).alias("statement_type"), F.coalesce(F.get_json_object("body", f"$.{t}") == "true", F.lit(False)).alias("flag")) for t in types))))


def page_is(pages: DataFrame, ask: providers.Ask, statement_type: str = "balance_sheet", flow: Flow = Flow()) -> DataFrame:
    """doc_id, page_num, yes: whether the image of each page holds one type of statement, a call per page that is answered by yes or no."""
    asked = pages.where("image is not null").select("doc_id", "page_num", "image", F.lit(f"Does this page hold a {statement_type.replace('_', ' ')}? Answer YES or NO.").alias("prompt"))
    return flow.ask(asked, ask, "page-is").select("doc_id", "page_num", F.coalesce(providers.says_yes(F.col("answer")), F.lit(False)).alias("yes"))


def balance_sheet_pages(pages: DataFrame, ask: providers.Ask) -> DataFrame:
    """detect() for balance sheets alone."""
    return detect(pages, ask, ["balance_sheet"])


def pages_found(documents: DataFrame, page_map: DataFrame) -> DataFrame:
    """doc_id, n_pages, detect_error: documents without any page end here."""
    n = page_map.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    d = documents.select("doc_id").distinct().join(n, "doc_id", "left").na.fill(0, ["n_pages"])
    return d.withColumn("detect_error", F.when(F.col("n_pages") == 0, "No statement pages found"))


def extract(pages: DataFrame, page_map: DataFrame, ask: providers.Ask, feedback: DataFrame | None = None, flow: Flow = Flow()) -> DataFrame:
    """Statements of a page map, merged over their pages. Pages whose answer isn't a statement are left out."""
    look = pages.select("doc_id", F.col("page_num").cast("int").alias("page_num"), "text", *(["image"] if "image" in pages.columns else []))
    j = page_map.join(look, ["doc_id", "page_num"])
    told = F.concat(F.lit("Give the "), F.col("statement_type"), F.lit(" on this page as JSON: title, periods, sections of rows (label, values, is_subtotal).\n"), F.coalesce("text", F.lit("")))
    if feedback is not None:
        j = j.join(feedback.select("doc_id", "statement_type", "feedback"), ["doc_id", "statement_type"], "left")
        told = F.concat(told, F.coalesce(F.concat(F.lit("\nMend this: "), "feedback"), F.lit("")))
    asked = j.select("doc_id", "statement_type", "page_pos", told.alias("prompt"), *(["image"] if "image" in pages.columns else []))
    got = flow.ask(asked, ask, "extract", batch=4)
    s = got.select("doc_id", "statement_type", "page_pos", F.from_json(X.model_text(F.col("answer")), STATEMENT).alias("s"))
    return S.merge_statements(s.select("doc_id", "statement_type", "page_pos", "s.*"))


def _verdict(answered: DataFrame, key: list[str]) -> DataFrame:
    v = F.from_json(X.model_text(F.col("answer")), VERDICT)
    return answered.select(*key, "error", v.alias("v")).select(*key, "error", "v.scores", "v.passed", "v.feedback")


def judge(statements: DataFrame, ask: providers.Ask | None = None, flow: Flow = Flow()) -> DataFrame:
    """doc_id, statement_type, scores, passed, feedback. The model's word counts; what can't be read has failed.

    Without a model the rules judge: completeness by the share of missing cells, format by the statement's shape.
    """
    key = ["doc_id", "statement_type"]
    if ask is None:
        gone = F.aggregate(F.flatten(F.transform(F.flatten("sections.rows"), lambda r: r["values"])), F.struct(F.lit(0).alias("n"), F.lit(0).alias("m")), lambda a, v: F.struct((a["n"] + 1).alias("n"), (a["m"] + F.coalesce(v.isin("", "null"), F.lit(True)).cast("int")).alias("m")))
        share = F.coalesce(F.try_divide(gone["m"], gone["n"]), F.lit(1.0))
        scores = F.create_map(F.lit("completeness"), F.round(10 * (1 - share), 0), F.lit("format"), F.when((F.size("periods") > 0) & (F.size("sections") > 0), 10.0).otherwise(0.0))
        return statements.select(*key, scores.alias("scores")).select(*key, "scores", validation.extraction_passed(F.col("scores")).alias("passed"), F.lit(None).cast("string").alias("feedback"))
    told = F.concat(F.lit("Score this statement from 0 to 10 as a JSON object: scores, passed, feedback.\n"), F.to_json(F.struct("title", "periods", "sections")))
    got = flow.ask(statements.select(*key, told.alias("prompt")), ask, "judge")
    v = _verdict(got, key)
    return v.select(*key, "scores", F.coalesce("passed", F.lit(False)).alias("passed"), F.coalesce("feedback", "error", F.lit("Answer can't be read")).alias("feedback"))


def extract_and_judge(pages: DataFrame, page_map: DataFrame, extractor: providers.Ask, judger: providers.Ask | None = None, flow: Flow = Flow()) -> tuple[DataFrame, DataFrame]:
    """Statements and verdicts; documents with a failed statement are extracted again, all of them, ATTEMPTS times in all."""
    todo, feedback, good, verdicts = page_map, None, None, None
    for attempt in range(1, ATTEMPTS + 1):
        s = flow.keep(extract(pages, todo, extractor, feedback, flow), "statements")
        v = flow.keep(judge(s, judger, flow), "verdicts").withColumn("attempt", F.lit(attempt))
        bad = validation.all_passed(v, todo).where("not passed").select("doc_id")
        bad = flow.keep(bad, "failed")
        last = attempt == ATTEMPTS or bad.isEmpty()
        done = (lambda d: d) if last else (lambda d: d.join(bad, "doc_id", "left_anti"))
        good = done(s) if good is None else good.unionByName(done(s))
        verdicts = done(v) if verdicts is None else verdicts.unionByName(done(v))
        if last:
            break
        todo, feedback = todo.join(bad, "doc_id", "left_semi"), v.where("not passed")
    return good, verdicts


def item_batches(items: DataFrame, size: int = 25) -> DataFrame:
    """doc_id, batch (from 0), lines: the items of a document in order, `size` to a batch, as the JSON that a prompt holds."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_pos", "row_pos"))
    b = items.withColumn("batch", F.floor((n - 1) / size).cast("int")).groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(F.struct("section_pos", "row_pos", "label", "section", "values"))).alias("i"))
    return b.select("doc_id", "batch", F.to_json(F.transform("i", lambda x: x.dropFields("section_pos", "row_pos"))).alias("lines"))


def ask_accounts(items: DataFrame, chart: DataFrame, ask: providers.Ask, rules: DataFrame | None = None, size: int = 25, again: bool = False, flow: Flow = Flow()) -> DataFrame:
    """doc_id, seq and RECORD: what the model answers for batches of `size` items of a document. Unreadable answers give nothing."""
    b, lines = item_batches(items, size), F.col("lines")
    head = F.lit(("These labels were unsure before; look again. " if again else "") + "Give each label its account as a JSON list of records (label, account_id, account_name, category, confidence, reasoning, needs_review, is_split).\n")
    b = b.join(small(A.chart_text(chart)))  # one row
    learned = F.lit("")
    if rules is not None:
        b = b.join(small(memory.prompt_lines(rules.withColumn("k", F.lit(1)), "k").select(F.col("prompt").alias("learned"))), F.lit(True), "left")  # one row, or none
        learned = F.coalesce(F.concat(F.lit("\n"), "learned"), F.lit(""))
    asked = b.select("doc_id", "batch", F.concat(head, F.col("text"), learned, F.lit("\n"), lines).alias("prompt"))
    got = flow.ask(asked, ask, "accounts", batch=1, pause=0.0)
    r = got.select("doc_id", "batch", F.posexplode(F.from_json(X.model_text(F.col("answer")), f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in RECORD.split(', '))}>>")).alias("pos", "r"))
    return r.select("doc_id", F.struct("batch", "pos").alias("seq"), "r.*")


def precheck(rows: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Quality counters of documents with `ignored` and `hard_fail`: learned corrections that were not heeded, and whether one counts twice."""
    r = rows.where("match_type is not null").withColumns({"header": F.coalesce(F.col("line_type") == "section_header", F.lit(False)), "code": F.col("coa_code")})
    q = telemetry.quality_counters(r, "doc_id")
    if rules is None:
        return q.withColumns({"ignored": F.lit(0).cast("long"), "hard_fail": F.lit(False)})
    bad = memory.ignored(r.select(F.col("doc_id").alias("row_id"), "label", "code"), rules).groupBy(F.col("row_id").alias("doc_id")).agg(F.count("*").alias("ignored"), F.bool_or("hard_fail").alias("hard_fail"))
    return q.join(bad, "doc_id", "left").na.fill(0, ["ignored"]).na.fill(False, ["hard_fail"])


def judge_categories(rows: DataFrame, ask: providers.Ask, rules: DataFrame | None = None, flow: Flow = Flow()) -> DataFrame:
    """doc_id, passed, feedback, hard_fail. Answers that can't be read leave it to the counters; calls that fail have failed."""
    q = precheck(rows, rules)
    lines = review.samples(rows).groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("place", "label", "section", "coa_code", "status")))).alias("lines"))
    told = F.concat(F.lit("Score these categories from 0 to 10 as a JSON object: scores, passed, feedback.\n"), F.to_json(F.struct("coverage", "high_share", "review_rate", "ignored")), F.lit("\n"), F.coalesce("lines", F.lit("[]")))
    asked = q.join(lines, "doc_id", "left").select("doc_id", "coverage", "ignored", "hard_fail", told.alias("prompt"))
    v = _verdict(flow.ask(asked, ask, "judge-categories"), ["doc_id", "coverage", "ignored", "hard_fail"])
    unread = F.col("error").isNull() & F.col("passed").isNull() & F.col("scores").isNull()
    passed = F.when(unread, (F.col("coverage") >= 0.7) & (F.col("ignored") == 0)).otherwise(F.coalesce("passed", F.lit(False)) & ~F.col("hard_fail"))
    return v.select("doc_id", passed.alias("passed"), F.coalesce("feedback", "error", F.lit("Judged by the counters")).alias("feedback"), "hard_fail")


def categorise(statements: DataFrame, chart: DataFrame, ask: providers.Ask, judger: providers.Ask, rules: DataFrame | None = None, matched: DataFrame | None = None, flow: Flow = Flow()) -> tuple[DataFrame, DataFrame]:
    """Categorised rows of income statements, and verdicts; failed documents' doubtful labels are asked again, ATTEMPTS times in all."""
    income, _ = review.gate(statements)
    every = review.rows_of(income)
    items = review.postable(every.where(~F.col("is_subtotal") & (F.coalesce("label", F.lit("")) != "")))[1]
    rows = flow.keep(review.categorise(every, ask_accounts(items, chart, ask, rules, flow=flow), matched), "rows")
    verdicts = flow.keep(judge_categories(rows, judger, rules, flow), "category-verdicts")
    for _ in range(ATTEMPTS - 1):
        bad = verdicts.where("not passed").select("doc_id")
        todo = review.retry_items(items, rows).join(bad, "doc_id", "left_semi")
        if todo.isEmpty():
            break
        rows = flow.keep(review.merge_retry(rows, ask_accounts(todo, chart, ask, rules, again=True, flow=flow)), "rows")
        again = judge_categories(rows.join(bad, "doc_id", "left_semi"), judger, rules, flow)
        verdicts = flow.keep(verdicts.join(bad, "doc_id", "left_anti").unionByName(again), "category-verdicts")
    return rows, verdicts


def outcome(documents: DataFrame, page_map: DataFrame, statements: DataFrame) -> DataFrame:
    """doc_id, status, detect_error, save_error: a document is processed if it has statements to save."""
    has = statements.select("doc_id").distinct().withColumn("saved", F.lit(True))
    d = pages_found(documents, page_map).join(has, "doc_id", "left")
    return d.select("doc_id", F.when(F.col("saved"), "processed").otherwise("failed").alias("status"), "detect_error", F.when(F.col("saved").isNull(), "No data to save").alias("save_error"))


def file_name(doc_id: Column, statement_type: Column, at: Column) -> Column:
    return F.concat_ws("_", doc_id, statement_type, F.date_format(at, "yyyyMMdd_HHmmss"))


class Result(NamedTuple):
    """What run() gives: documents with their outcome, page map, statements to save, verdicts, categorised rows and their verdicts (or None)."""

    outcome: DataFrame
    page_map: DataFrame
    statements: DataFrame
    verdicts: DataFrame
    rows: DataFrame | None
    row_verdicts: DataFrame | None


def run(pages: DataFrame, extractor: providers.Ask, judger: providers.Ask | None = None, chart: DataFrame | None = None, categoriser: providers.Ask | None = None, types: list[str] = TYPES, rules: DataFrame | None = None, flow: Flow = Flow()) -> Result:
    """The whole flow over pages (doc_id, page_num, text, perhaps image): detect, extract and judge, categorise and judge, outcome.

    Without a chart of accounts and a categoriser nothing is categorised. `flow` says where stages are kept (a Ledger's run
    goes on where it was cut off), which answers are known already, and where the run's events go.
    """
    if flow.journal:
        flow.journal.started(pages)
    page_map = flow.keep(detect(pages, extractor, types, flow), "page-map")
    statements, verdicts = extract_and_judge(pages, page_map, extractor, judger, flow)
    rows = row_verdicts = None
    if chart is not None and categoriser is not None:
        rows, row_verdicts = categorise(statements, chart, categoriser, judger or categoriser, rules, flow=flow)
    end = outcome(pages, page_map, statements)
    if flow.journal:
        flow.journal.scores(verdicts)
        flow.journal.completed(end, verdicts)
    return Result(end, page_map, statements, verdicts, rows, row_verdicts)
