"""Dropped reports to saved statements, as a stream: each document settles once, whatever is killed on the way."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.flow import Ledger, path_of
from ..sources import files

#: Of a batch's documents (doc_id, path, content), its ledger and number: saves under the number whatever comes of them.
Process = Callable[[DataFrame, Ledger, int], None]
SETTLED = "path string, modified timestamp, length long, doc_id string"


def settled(spark: SparkSession, out: str) -> DataFrame:
    """Documents that a finished batch has dealt with."""
    fs, p = path_of(spark, f"{out}/_settled")
    if not fs.exists(p):
        return spark.createDataFrame([], SETTLED + ", batch long")
    return spark.read.schema(SETTLED + ", batch long").parquet(f"{out}/_settled")


def note(spark: SparkSession, folder: str, out: str, pattern: str, files_per_batch: int, bytes_per_batch: int | None) -> None:
    """Add the names of documents that aren't in out/_noted yet to it, those of a batch as one file; the driver lists none of them."""
    fs, at = path_of(spark, f"{out}/_noted")
    fs.mkdirs(at)
    known, found = spark.read.schema(files.NAMES).parquet(f"{out}/_noted"), f"{out}/_work/found"
    files.names(spark, folder, pattern).join(known, ["path", "modificationTime", "length"], "left_anti").write.mode("overwrite").parquet(found)
    new = spark.read.schema(files.NAMES).parquet(found)
    n = new.agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).first()
    if n["files"]:
        batches = math.ceil(n["bytes"] / bytes_per_batch) if bytes_per_batch else math.ceil(n["files"] / files_per_batch)
        new.repartition(max(batches, 1)).write.mode("append").option("maxRecordsPerFile", 0 if bytes_per_batch else files_per_batch).parquet(f"{out}/_noted")
    fs.delete(path_of(spark, found)[1], True)


def batch_of(process: Process, out: str, read: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """What foreachBatch does; `read` adds their content to documents that come as names. A batch that is given again goes on in its own ledger and writes over its own files.

    The ledger's first stage fixes which documents are the batch's: new by path, time and length. A name is dropped
    twice with another content: it is a new document. The batch is settled last; then its ledger goes.
    """

    def run(dropped: DataFrame, batch: int) -> None:
        spark = dropped.sparkSession
        mark = f"{out}/_settled/batch={batch}"
        fs, done = path_of(spark, f"{mark}/_SUCCESS")
        if fs.exists(done):
            return
        key = ["path", "modificationTime", "length"]
        d = dropped.dropDuplicates(key).join(settled(spark, out).withColumnRenamed("modified", "modificationTime"), key, "left_anti")
        d = (read(d) if read else d).select("path", F.col("modificationTime").alias("modified"), "length", "content", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"))
        ledger = Ledger(spark, f"{out}/_work/batch-{batch}")
        new = ledger(d, "documents")
        if not new.isEmpty():
            process(new.select("doc_id", "path", "content"), ledger, batch)
        new.select(*(c.split()[0] for c in SETTLED.split(", "))).write.mode("overwrite").parquet(mark)
        ledger.clear()

    return run


def ingest(spark: SparkSession, folder: str, out: str, process: Process, pattern: str = "*.pdf", files_per_trigger: int = 100, bytes_per_trigger: int | None = None) -> StreamingQuery:
    """Take the documents that lie in a folder, and in those it was dealt into, batch by batch, then stop; the next call takes what was dropped since.

    A batch has at most `files_per_trigger` documents or, if given, about `bytes_per_trigger` instead: it costs some dozen jobs,
    so small documents want many to a batch. Names are noted in out/_noted first, and are what is streamed; contents are read by
    the tasks of a batch. Where Python workers can't open the store, or the folder is a pattern, Spark's file stream lists the
    documents on the driver; so it does for an `out` that was begun so, whose checkpoint is of that stream. Progress is in out/_checkpoint, settled documents in out/_settled, the stages of an unfinished batch in out/_work.
    """
    fs, noted = path_of(spark, f"{out}/_noted")
    begun_by_files = fs.exists(path_of(spark, f"{out}/_checkpoint")[1]) and not fs.exists(noted)
    by_tasks = files.listed_by_tasks(folder)
    if by_tasks and begun_by_files and files.dealt(files.store_of(folder)[0], files.store_of(folder)[1]):
        raise ValueError("documents were dealt into folders, where the file stream that this output was begun by doesn't look")
    if by_tasks and not begun_by_files:
        note(spark, folder, out, pattern, files_per_trigger, bytes_per_trigger)
        stream = spark.readStream.schema(files.NAMES).option("maxFilesPerTrigger", 1).parquet(f"{out}/_noted")
        read = lambda d: files.contents(d, folder, spark.sparkContext.defaultParallelism)
    else:
        stream, read = files.report_stream(spark, folder, pattern, files_per_trigger, bytes_per_trigger), None
    return stream.writeStream.foreachBatch(batch_of(process, out, read)).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start()
