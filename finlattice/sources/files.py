"""Scans: folders of reports, statements, charts of accounts, rule files, run metrics, event logs, usage."""

from __future__ import annotations

import fnmatch
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spreadsheets import dealt, store_of

STATEMENT_TYPES = ["balance_sheet", "income_statement", "cash_flow"]
STATEMENT = "title string, statement_type string, periods array<string>, sections array<struct<name string, rows array<struct<label string, values array<string>, is_subtotal boolean>>>>"
RUN = "run_id string, timestamp string, total_duration double, llm_calls int, retries int, success boolean, error_message string"
EVENT = "timestamp string, event string, run_id string, duration_ms double"
NAMES = "path string, modificationTime timestamp, length long"
DROPPED = f"{NAMES}, content binary"
USAGE = "tier string, current_month_count int, month_start string, total_extractions int"


def listed(spark: SparkSession, folder: str, pattern: str = "*", whole: bool = False) -> DataFrame:
    """path, stem, length, modified of the files in a folder, newest first; contents aren't read.

    With `whole`, a folder in it, such as a table of several files, is one entry too: its files' length together and
    the time of the newest.
    """
    if whole:
        root = spark._jvm.org.apache.hadoop.fs.Path(folder)
        root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
        f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        entry = F.regexp_extract(F.substring("path", len(root) + 2, 1 << 30), "^[^/]+", 0)
        f = f.select(entry.alias("entry"), "length", "modificationTime").where(F.col("entry").rlike("^" + fnmatch.translate(pattern)))
        f = f.groupBy(F.concat(F.lit(f"{root}/"), "entry").alias("path")).agg(F.sum("length").alias("length"), F.max("modificationTime").alias("modificationTime"))
    else:
        f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return f.select("path", stem.alias("stem"), "length", F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "path")


def reports(spark: SparkSession, folder: str, pattern: str = "*.pdf", whole: bool = False) -> DataFrame:
    """Files to process: none whose stem names a statement type, for those are parts of others."""
    return listed(spark, folder, pattern, whole).where(~F.col("stem").rlike("|".join(STATEMENT_TYPES)))


def report_contents(spark: SparkSession, path: str, folder: bool = True, pattern: str = "*.pdf") -> DataFrame:
    """doc_id, path, content of the reports() of a folder, or of one file; the driver lists none of them."""
    raw = spark.read.format("binaryFile")
    raw = (raw.option("pathGlobFilter", pattern) if folder else raw).load(path).select("path", "content")
    named = raw.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), "path", "content")
    return named.where(~F.col("doc_id").rlike("|".join(STATEMENT_TYPES))) if folder else named


def outputs_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return listed(spark, folder).where(F.col("stem").startswith(f"{name}_"))


def as_base64(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", encoded(F.col("content")).alias("base64"))


def encoded(content: Column) -> Column:
    """Base64 in one line."""
    return F.regexp_replace(F.base64(content), r"\s", "")


def page_count(info: Column) -> Column:
    """The number on the `Pages:` line of a report's description; null without one."""
    return F.regexp_extract(info, r"(?m)^Pages:\s*(\d+)", 1).try_cast("int")


def page_numbers(pages: Column) -> Column:
    """Pages counted from 0 as pages counted from 1."""
    return F.transform(pages, lambda p: p + 1)


def statements(spark: SparkSession, path: str) -> DataFrame:
    """Statement files; doc_id is the file's stem."""
    s = spark.read.schema(STATEMENT).option("multiLine", True).json(path)
    return s.select(F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), "*")


def statements_of(texts: DataFrame) -> DataFrame:
    """Statements out of texts (doc_id, value); a text that isn't a statement has nulls."""
    return texts.select("doc_id", F.from_json("value", STATEMENT).alias("s")).select("doc_id", "s.*")


def accounts(spark: SparkSession, path: str) -> DataFrame:
    """code, name, description, pos of a chart of accounts: one JSON list, in its order. A missing file is an error."""
    return accounts_of(spark.read.text(path, wholetext=True))


def accounts_of(texts: DataFrame) -> DataFrame:
    """accounts() of the text in `value`."""
    a = texts.select(F.posexplode(F.from_json("value", "array<struct<code string, name string, description string>>")).alias("pos", "a"))
    return a.select("a.code", "a.name", "a.description", "pos")


def rules(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """Correction rules of Markdown tables (small files), with the file's stem as practice_id.

    Rows follow a line that begins with |---; they need five cells, the sixth is the count (1 if it isn't a
    number). Empty cells keep their place; `compat` drops them, and rows with the word Label, as it once was.
    """
    f = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("practice_id"), "value")
    return rules_of(f, compat)


def rule_file(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """rules() of one small file, which the driver reads: scans pass over names that begin with _, such as _default.md. No file: no rules."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    text = ""
    if store.exists(p):
        stream = store.open(p)
        try:
            text = spark._jvm.java.lang.String(stream.readAllBytes(), "UTF-8")
        finally:
            stream.close()
    name = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return rules_of(spark.createDataFrame([(name, str(text))], "practice_id string, value string"), compat)


def rules_of(texts: DataFrame, compat: bool = False) -> DataFrame:
    """rules() of texts (practice_id, value)."""
    f = texts.select("practice_id", F.split("value", "\r?\n").alias("lines"))
    rule_at = F.array_position(F.transform("lines", lambda x: F.trim(x).startswith("|---")), F.lit(True))
    f = f.select("practice_id", rule_at.alias("at"), F.posexplode("lines").alias("pos", "line")).where((F.col("at") > 0) & (F.col("pos") >= F.col("at")))
    line = F.trim("line")
    f = f.where(line.startswith("|"))
    parts = F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    if compat:
        f, parts = f.where(~F.col("line").contains("Label")), F.filter(parts, lambda x: x != "")
    f = f.withColumn("cells", parts).where(F.size("cells") >= 5)
    names = ["label", "section", "wrong_code", "correct_code", "correct_name"]
    return f.select("practice_id", *(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)), F.coalesce(F.get("cells", F.lit(5)).try_cast("int"), F.lit(1)).alias("count"), F.col("pos").alias("seq"))


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Run metrics, one JSON file each, with the file's time as `modified`."""
    return spark.read.schema(RUN).option("multiLine", True).json(path).select("*", F.col("_metadata.file_modification_time").alias("modified"))


def runs_of(texts: DataFrame) -> DataFrame:
    """Run metrics out of texts (value)."""
    return texts.select(F.from_json("value", RUN).alias("r")).select("r.*")


def events_of(lines: DataFrame) -> DataFrame:
    """Events out of the lines of a log (value); lines that can't be read are left out."""
    return _timed(lines.select(F.from_json("value", EVENT).alias("e")).where("e.event is not null").select("e.*"))


def _timed(events: DataFrame) -> DataFrame:
    """Times as written in ISO form, to the microsecond; the JSON reader's own timestamps end at milliseconds."""
    return events.withColumn("timestamp", F.col("timestamp").try_cast("timestamp"))


def event_log(spark: SparkSession, path: str) -> DataFrame:
    return _timed(spark.read.schema(EVENT).json(path))


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same log as a stream of appended files."""
    return _timed(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path))


def usage(spark: SparkSession, path: str) -> DataFrame:
    """user_id and usage record; no rows if there is no file yet."""
    try:
        raw = spark.read.schema(f"users map<string, struct<{USAGE.replace(' ', ': ').replace(',: ', ', ')}>>").option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"user_id string, {USAGE}")
    return raw.select(F.explode("users").alias("user_id", "u")).select("user_id", "u.*")


def usage_of(texts: DataFrame) -> DataFrame:
    """usage() of the text in `value`."""
    users = F.from_json("value", f"struct<users: map<string, struct<{USAGE.replace(' ', ': ').replace(',: ', ', ')}>>>")["users"]
    return texts.select(F.explode(users).alias("user_id", "u")).select("user_id", "u.*")


def report_stream(spark: SparkSession, folder: str, pattern: str = "*.pdf", files_per_trigger: int = 100, bytes_per_trigger: int | None = None) -> DataFrame:
    """Documents that are dropped into a folder, as a stream: path, modificationTime, length, content."""
    size = ("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else ("maxFilesPerTrigger", files_per_trigger)
    return spark.readStream.format("binaryFile").schema(DROPPED).option("pathGlobFilter", pattern).option(*size).load(folder)


def listed_by_tasks(folder: str) -> bool:
    """Whether names() can list a folder: no pattern, and in a store that Python workers can open."""
    from pyarrow import ArrowException

    try:
        return not re.search(r"[*?\[{]", folder) and bool(store_of(folder))
    except (ArrowException, OSError):
        return False


def _roots(spark: SparkSession, folder: str) -> tuple[str, str]:
    """A folder as Spark's scans name it, and in its store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/"), store_of(folder)[1].rstrip("/")


def names(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length of the files in a folder and in those it was dealt into, as Spark's scans say them; each folder is listed by a task."""
    shown, root = _roots(spark, folder)
    folders = ["", *(f[len(root) :] for f in dealt(store_of(folder)[0], root))]

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store = store_of(folder)[0]
        for b in batches:
            for within in b.column(0).to_pylist():
                found = [(f"{shown}{within}/{f.base_name}", f.base_name, f.mtime_ns // 1_000_000, f.size) for f in store.get_file_info(fs.FileSelector(root + within)) if f.is_file and f.base_name[0] not in "._"]
                for i in range(0, len(found), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found[i : i + 20_000]), (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["path", "name", "ms", "length"])

    matches = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    found = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(min(len(folders), 1000)).mapInArrow(run, "path string, name string, ms long, length long")
    return found.where(F.col("name").rlike(f"^(?:{matches})$")).select("path", F.timestamp_millis("ms").alias("modificationTime"), "length")


def contents(found: DataFrame, folder: str, tasks: int) -> DataFrame:
    """Files of names() with their content; those that are gone are left out."""
    shown, root = _roots(found.sparkSession, folder)

    def run(batches):
        store = store_of(folder)[0]
        for b in batches:
            done, size = [], 0
            for i, path in enumerate(b.column("path").to_pylist()):
                try:
                    with store.open_input_file(root + path[len(shown) :]) as f:
                        done.append((i, f.read()))
                except FileNotFoundError:
                    continue
                size += len(done[-1][1])
                if size > 8 << 20:
                    yield with_content(b, done)
                    done, size = [], 0
            yield with_content(b, done)

    def with_content(b, done):
        import pyarrow as pa

        return b.take(pa.array([i for i, _ in done], pa.int64())).append_column("content", pa.array([c for _, c in done], pa.binary()))

    return found.select("path", "modificationTime", "length").repartition(tasks).mapInArrow(run, DROPPED)
