"""Writers: statements, rule files, run metrics and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Times in logs are written to the microsecond; without it the writer stops at milliseconds.
LOG_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def preferred(extracted: DataFrame, categorised: DataFrame) -> DataFrame:
    """Categorised statements, and of the others the extracted ones (doc_id, statement_type name a statement)."""
    key = ["doc_id", "statement_type"]
    return categorised.unionByName(extracted.join(categorised.select(*key), key, "left_anti"), allowMissingColumns=True)


def statement_json(statement: Column) -> Column:
    """Indented JSON; nulls are written."""
    return F.to_json(statement, {"ignoreNullFields": "false", "pretty": "true"})


def write_statements(statements: DataFrame, path: str, batch: int | None = None) -> None:
    """JSON by statement type, added to what is there; a batch has a folder of its own, which it writes over."""
    w = statements.write.option("ignoreNullFields", False).partitionBy("statement_type")
    w.mode("append").json(path) if batch is None else w.mode("overwrite").json(f"{path}/batch={batch}")


def write_metrics(runs: DataFrame, path: str, batch: int | None = None) -> None:
    """One JSON line per run, likewise."""
    w = runs.write.options(**LOG_TIME).option("ignoreNullFields", False)
    w.mode("append").json(path) if batch is None else w.mode("overwrite").json(f"{path}/batch={batch}")


def rule_files(rules: DataFrame) -> DataFrame:
    """practice_id, value: a Markdown table per practice (its rules are few), rules in order of seq."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("label", "section", "wrong_code", "correct_code", "correct_name", "count")]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    g = rules.groupBy("practice_id").agg(F.array_sort(F.collect_list(F.struct("seq", row.alias("row")))).alias("r"))
    head = F.concat(F.lit("---\npractice_id: "), F.col("practice_id"), F.lit("\n---\n\n| Label | Section | Wrong Code | Correct Code | Correct Name | Count |\n|---|---|---|---|---|---|\n"))
    return g.select("practice_id", F.concat(head, F.array_join("r.row", "\n")).alias("value"))


def write_rules(rules: DataFrame, path: str) -> None:
    """Replace the files of the practices that `rules` holds; those of others stay."""
    rule_files(rules).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("practice_id").text(path)


def append_log(events: DataFrame, path: str) -> None:
    """One JSON line per event, in a folder per day."""
    events.withColumn("date", F.to_date("timestamp")).write.mode("append").options(**LOG_TIME).partitionBy("date").json(path)


def log_line(*fields: Column) -> Column:
    """An event as a line of the log."""
    return F.to_json(F.struct(*fields), LOG_TIME)


def write_usage(usage: DataFrame, path: str) -> None:
    """Replace the usage file by one document {"users": {user_id: record}}; users of one installation are few."""
    usage_json(usage).coalesce(1).write.mode("overwrite").text(path)


def usage_json(usage: DataFrame) -> DataFrame:
    """One row, `value`: the usage document."""
    record = F.struct(*(c for c in usage.columns if c != "user_id"))
    return usage.agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(F.struct("user_id", record.alias("r"))))).alias("users")), {"ignoreNullFields": "false"}).alias("value"))


def clean(spark: SparkSession, folder: str, pattern: str = "*") -> int:
    """Delete what matches in a folder, files and whole folders, in whatever store it lies; returns how many."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(bool(store.delete(f.getPath(), True)) for f in store.globStatus(path) or [])
