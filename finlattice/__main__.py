"""python -m finlattice: statements out of a folder of reports, or one of them.

Readers and models are given as module:function; the default reader calls the Poppler tools, and no model comes with the library.
"""

from __future__ import annotations

import argparse
import importlib
import sys
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import memory, review, telemetry
from .plans import providers, workflow
from .plans.flow import AnswerCache, Flow, Journal
from .plans.tables import kept
from .sources import documents, files, sinks, spreadsheets, workbook
from .streaming.ingest import ingest


def function(name: str | None):
    """What `module:function` names."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def model(name: str | None, endpoint: str | None):
    return providers.ChatEndpoint(endpoint, name) if endpoint and name else function(name)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="finlattice", description="Balance sheets, income statements and cash flows out of reports.")
    p.add_argument("--pdf", help="one report")
    p.add_argument("--folder", default="input", help="a folder of reports (default: input)")
    p.add_argument("--out", default="output", help="where results go (default: output)")
    p.add_argument("--tmp", default="tmp", help="the folder that --clean empties (default: tmp)")
    p.add_argument("--statements", default="all", help="balance_sheet, income_statement, cash_flow, by commas (default: all)")
    p.add_argument("--reader", default="finlattice.sources.poppler:texts", help="module:function, bytes -> a text per page (default: by Poppler)")
    p.add_argument("--renderer", help="module:function, (bytes, page, dpi) -> image; pages without text need it, e.g. finlattice.sources.poppler:image")
    p.add_argument("--model", help="module:function that answers every prompt, or a model's name at --endpoint")
    p.add_argument("--endpoint", help="the URL of a chat endpoint; models are names there then")
    p.add_argument("--extraction-model", help="for page detection and extraction, instead of --model")
    p.add_argument("--eval-model", help="for judging, instead of --model; without any the rules judge")
    p.add_argument("--chart", help="the chart of accounts, a JSON list; without it nothing is categorised")
    p.add_argument("--no-categorization", action="store_true", help="extract only")
    p.add_argument("--memory", help="a folder of correction rules: _default.md, and a file per practice")
    p.add_argument("--practice", help="whose rules count before the default ones")
    p.add_argument("--cache", help="a folder of answers; what a model was asked before isn't asked again")
    p.add_argument("--pace", type=float, help="prompts a second at most, per worker")
    p.add_argument("--stream", action="store_true", help="take what was dropped into the folder since the last call; a run that was cut off goes on")
    p.add_argument("--clean", action="store_true", help="empty the folder of temporary files, and nothing else")
    return p


def pages_of(docs: DataFrame, reader, renderer) -> DataFrame:
    """doc_id, page_num, text (and image, of documents without text) of documents (doc_id, path, content)."""
    pages = documents.page_texts(docs, reader)
    if renderer:
        blank = workflow.has_text(pages.withColumnRenamed("path", "doc_id")).where("not has_text").select(F.col("doc_id").alias("path"))
        shown = pages.select("path", "page_num").join(blank, "path", "left_semi").join(docs.select("path", "content"), "path")
        pages = pages.join(documents.page_images(shown, renderer, strict=False), ["path", "page_num"], "left")
    return pages.join(docs.select("path", "doc_id"), "path").drop("path")


def save(result: workflow.Result, out: str, at: Column | None = None, batch: int | None = None) -> None:
    """Statements as JSON and as spreadsheets, one per document and type; categorised ones where there are any.

    Files of a batch are named by its time `at` and lie in its own folder, so that saving it again writes over them.
    """
    at = F.current_timestamp() if at is None else at
    found = result.statements
    if result.rows is not None:
        kept = found.select("doc_id", "statement_type", "title", "periods")
        found = sinks.preferred(found.select(*found.columns), review.nested(result.rows).join(kept, ["doc_id", "statement_type"]).select("doc_id", "statement_type", "title", "periods", F.col("sections").alias("categorised")))
        plain = found.where("categorised is null").drop("categorised")
        rich = found.where("categorised is not null").drop("sections").withColumnRenamed("categorised", "sections")
        parts = [plain, rich]
    else:
        parts = [found]
    for k, s in enumerate(parts):
        sinks.write_statements(s, f"{out}/json" if not k else f"{out}/json-categorised", batch)
        name = F.concat(workflow.file_name(F.col("doc_id"), F.col("statement_type"), at), F.lit(".xlsx"))
        key = F.concat_ws("\u0001", "doc_id", "statement_type")
        cells = review.sheet(s.withColumn("doc_id", key))
        named = s.select(key.alias("doc_id"), name.alias("name"), F.col("statement_type").alias("sheet"))
        spreadsheets.save(workbook.files(cells.join(named, "doc_id").select("name", "sheet", "row_no", "col_no", "value", "style")), out)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if every report gave statements, else 1."""
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("finlattice").getOrCreate()
    if a.clean:
        print(f"{sinks.clean(spark, a.tmp)} files and folders deleted")
        return 0
    extractor, judger = model(a.extraction_model or a.model, a.endpoint), model(a.eval_model or a.model, a.endpoint)
    if extractor is None:
        print("a model is needed", file=sys.stderr)
        return 1
    chart = files.accounts(spark, a.chart) if a.chart and not a.no_categorization else None
    books = model(a.model or a.extraction_model, a.endpoint) if chart is not None else None
    named = {extractor: a.extraction_model or a.model, judger: a.eval_model or a.model, books: a.model or a.extraction_model}
    caches = {m: AnswerCache(spark, a.cache, n) for m, n in named.items() if a.cache and m is not None}
    rules = learned_rules(spark, a.memory, a.practice) if a.memory else None
    ended: list[tuple[int, int]] = []

    def process(docs: DataFrame, keep, batch: int | None = None) -> None:
        journal = Journal(f"{a.out}/logs", f"{a.out}|{uuid.uuid4().hex if batch is None else batch}")
        flow = Flow(keep, caches, journal, a.pace)
        pages = keep(pages_of(docs, function(a.reader), function(a.renderer)), "pages")
        result = workflow.run(pages, extractor, judger, chart, books, workflow.statement_types(a.statements), rules, flow)
        at = keep(spark.range(1).select(F.current_timestamp().alias("at")), "time").first()["at"]
        save(result, a.out, F.lit(at), batch)
        own = result.outcome.select(journal.run_id(F.col("doc_id")).alias("run_id"))
        sinks.write_metrics(journal.metrics(spark).join(own, "run_id", "left_semi"), f"{a.out}/metrics", batch)
        n = telemetry.outcomes(result.outcome).first()
        ended.append((n.processed, n.failed))

    if a.stream:
        ingest(spark, a.folder, a.out, process).awaitTermination()
    else:
        docs = files.report_contents(spark, a.pdf or a.folder, not a.pdf)
        if docs.isEmpty():
            print("no reports", file=sys.stderr)
            return 1
        process(docs, kept)
    processed, failed = (sum(x) for x in zip(*ended)) if ended else (0, 0)
    print(f"{processed} processed, {failed} failed, of {processed + failed}")
    return 1 if failed else 0


def learned_rules(spark: SparkSession, folder: str, practice: str | None) -> DataFrame:
    """Rules of the default table and of a practice, whose own win: _default.md and <practice>.md."""
    default = files.rule_file(spark, f"{folder}/_default.md")
    return memory.effective(default, files.rule_file(spark, f"{folder}/{practice}.md") if practice else default.limit(0))


if __name__ == "__main__":
    sys.exit(main())
