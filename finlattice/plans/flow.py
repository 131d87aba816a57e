"""What the stages of a run share: where they write, which answers are known already, and the log of what was done."""

from __future__ import annotations

import threading
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from ..streaming import runs
from . import providers
from .tables import kept


def path_of(spark: SparkSession, path: str):
    """The store and the path in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Ledger:
    """Stages of one run as tables in a folder: a stage that has been written is read, not made again.

    keep(df, name) writes the run's next stage of that name. What a run does next depends on written tables alone, so
    a run that begins again meets the same stages in the same order, up to the one where its driver was lost. A stage
    that was cut off has no _SUCCESS and is written anew. A folder belongs to one run and its inputs.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.seen: Counter = Counter()
        self.made: list[str] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.seen[name] += 1
        path = f"{self.folder}/{name}-{self.seen[name]:02d}"
        fs, done = path_of(self.spark, f"{path}/_SUCCESS")
        if not fs.exists(done):
            df.write.mode("overwrite").parquet(path)
            self.made.append(path.rsplit("/", 1)[1])
        return self.spark.read.schema(df.schema).parquet(path)

    def stages(self) -> list[tuple[str, int]]:
        """Stage and attempt of what is done, in the order it was written; a run has some dozen."""
        fs, p = path_of(self.spark, self.folder)
        done = []
        for f in fs.listStatus(p) if fs.exists(p) else []:
            mark = path_of(self.spark, f"{f.getPath()}/_SUCCESS")[1]
            if fs.exists(mark):
                stage, _, attempt = f.getPath().getName().rpartition("-")
                done.append((fs.getFileStatus(mark).getModificationTime(), stage, int(attempt)))
        return [(stage, attempt) for _, stage, attempt in sorted(done)]

    def clear(self) -> None:
        fs, p = path_of(self.spark, self.folder)
        fs.delete(p, True)


class AnswerCache:
    """Answers of one model by a digest of prompt and image, as Parquet that is only added to.

    Equal prompts are asked once. Two runs at once may both ask and add an answer; readers take one of them. Errors aren't kept.
    """

    SCHEMA = "digest string, answer string"

    def __init__(self, spark: SparkSession, folder: str, model: str):
        self.spark, self.model = spark, model
        self.path = f"{folder.rstrip('/')}/model={providers.safe_name(model)}"

    def digest(self, columns: list[str]) -> Column:
        image = F.sha2(F.col("image"), 256) if "image" in columns else F.lit(None).cast("string")
        return F.sha2(F.concat_ws("\u0001", F.lit(self.model), F.coalesce(image, F.lit("-")), F.col("prompt")), 256)

    def known(self) -> DataFrame:
        fs, p = path_of(self.spark, self.path)
        if not fs.exists(p):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).groupBy("digest").agg(F.min("answer").alias("answer"))

    def answers(self, requests: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """As ask(requests), where answers that are known aren't asked for; those come with an ms of 0."""
        keyed = requests.where("prompt is not null").withColumn("digest", self.digest(requests.columns))
        wanted = [c for c in ("digest", "prompt", "image") if c in keyed.columns]
        fresh = kept(ask(keyed.join(self.known(), "digest", "left_anti").select(*wanted).dropDuplicates(["digest"])), "asked")
        fresh.where("error is null and answer is not null").select("digest", "answer").coalesce(1).write.mode("append").parquet(self.path)
        new = fresh.select("digest", F.col("answer").alias("new"), "error", "ms")
        out = keyed.drop("prompt", "image").join(new, "digest", "left").join(self.known(), "digest", "left")
        return out.withColumn("answer", F.coalesce("new", "answer")).withColumn("ms", F.coalesce("ms", F.lit(0.0))).drop("digest", "new")


class Journal:
    """Events of the runs of documents, in the log that sinks.append_log writes and streaming.runs reads."""

    def __init__(self, path: str, batch: str):
        self.path, self.batch = path, batch
        self.said: Counter = Counter()

    def run_id(self, doc_id: Column) -> Column:
        """One run per document and batch, the same when the batch begins again."""
        return F.substring(F.sha2(F.concat_ws("|", F.lit(self.batch), doc_id), 256), 1, 16)

    def add(self, rows: DataFrame, event: str, part: Column | None = None, **more: Column) -> None:
        """One event per row of `rows` (doc_id); `part` tells apart several of a document. An event said again has the same id."""
        self.said[event] += 1
        run = self.run_id(F.col("doc_id").cast("string"))
        number = F.concat_ws("|", run, F.lit(event), F.lit(self.said[event]), *([] if part is None else [part]))
        named = {f.split()[0]: f.split()[1] for f in runs.EVENT.split(", ")}
        values = {"event_id": F.sha2(number, 256), "timestamp": F.current_timestamp(), "event": F.lit(event), "run_id": run} | more
        sinks.append_log(rows.select(*(values.get(n, F.lit(None)).cast(k).alias(n) for n, k in named.items())), self.path)

    def started(self, documents: DataFrame) -> None:
        self.add(documents.select("doc_id").distinct(), runs.STARTED, pdf_file=F.col("doc_id").cast("string"))

    def calls(self, answered: DataFrame, node: str) -> None:
        """A call event per request that was asked, and per document what the node's calls took together."""
        keys = [c for c in answered.columns if c not in ("answer", "error", "ms")]
        asked = answered.where("ms > 0")
        self.add(asked, runs.CALL, F.to_json(F.struct(*keys)), node=F.lit(node), duration_ms=F.col("ms"), success=F.col("error").isNull(), error_message=F.col("error"))
        self.add(answered.groupBy("doc_id").agg(F.sum("ms").alias("ms")), runs.NODE, node=F.lit(node), duration_ms=F.col("ms"))

    def scores(self, verdicts: DataFrame) -> None:
        """The mean score of each statement."""
        mean = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, x: a + x) / F.size("scores")
        self.add(verdicts.where("scores is not null"), runs.EVALUATION, F.col("statement_type"), statement_type=F.col("statement_type"), score=mean)

    def completed(self, outcome: DataFrame, verdicts: DataFrame) -> None:
        tries = verdicts.groupBy("doc_id").agg((F.max("attempt") - 1).alias("retries"))
        o = outcome.join(tries, "doc_id", "left")
        self.add(o, runs.COMPLETED, success=F.col("status") == "processed", retry_count=F.coalesce("retries", F.lit(0)), error_message=F.coalesce("detect_error", "save_error"))

    def metrics(self, spark: SparkSession) -> DataFrame:
        """run_rows() of the whole log."""
        log = spark.read.schema(runs.EVENT.replace("timestamp timestamp", "timestamp string")).json(self.path)
        return runs.run_rows(log.withColumn("timestamp", F.col("timestamp").try_cast("timestamp")))


class Pace:
    """At most `per_second` prompts a second from each Python worker of an executor."""

    _free: dict[float, float] = {}
    _lock = threading.Lock()

    def __init__(self, ask: providers.Ask, per_second: float):
        self.ask, self.per_second = ask, per_second

    def __call__(self, prompts: list, images: list) -> list:
        with Pace._lock:
            now = time.monotonic()
            begin = max(now, Pace._free.get(self.per_second, 0.0))
            Pace._free[self.per_second] = begin + len(prompts) / self.per_second
        time.sleep(begin - now)
        return self.ask(prompts, images)

    def __reduce__(self):
        return Pace, (self.ask, self.per_second)


@dataclass
class Flow:
    """How stages are kept, and perhaps: caches of answers by model function, a journal, a pace of prompts a second."""

    keep: Callable[[DataFrame, str], DataFrame] = kept
    caches: dict = field(default_factory=dict)
    journal: Journal | None = None
    pace: float | None = None

    def ask(self, requests: DataFrame, model: providers.Ask, node: str, **options) -> DataFrame:
        """Answers to requests (doc_id, prompt, perhaps image), written."""
        paced = Pace(model, self.pace) if self.pace else model
        ask = lambda r: providers.answers(r, paced, **options)
        cache = self.caches.get(model)
        out = self.keep(ask(requests) if cache is None else cache.answers(requests, ask), node)
        if self.journal:
            self.journal.calls(out, node)
        return out
