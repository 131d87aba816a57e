"""Shared plumbing: the cluster's shared folder, materialised steps and Arrow batching."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised pass works on; a longer text is a pass of its own.
PASS_BYTES = 2 << 20


#: Spark's setting that removes the shuffle files of a query when it has ended; every step here is a query of its own.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A folder for the steps of a local session that names none.
LOCAL_DIR = Path(tempfile.gettempdir()) / "finlattice-checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; an error if a cluster names none, as executors don't share local folders."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return LOCAL_DIR.as_uri()


#: Where the operators called by this thread note their folders, inside `with collected()`.
_NOTED: ContextVar[list[Scratch] | None] = ContextVar("noted", default=None)


@contextmanager
def collected() -> Iterator[Callable[[], None]]:
    """The scratch tables of the operators called inside, by this thread alone: the function given removes them.

    It is called when the results have been written, as nothing lazy may read the tables any more. Operators that run
    in other threads meanwhile keep theirs.
    """
    own: list[Scratch] = []

    def spent() -> None:
        for s in own:
            fs, p = s._path(s.root)
            fs.delete(p, True)
        own.clear()

    token = _NOTED.set(own)
    try:
        yield spent
    finally:
        _NOTED.reset(token)


class _Cleanup:
    """CLEANUP is on in a session while any of its threads writes a step; the last one out puts back what was there."""

    def __init__(self):
        self.lock, self.writers, self.before = threading.Lock(), 0, "false"

    @contextmanager
    def on(self, spark: SparkSession) -> Iterator[None]:
        with self.lock:
            if not self.writers:
                self.before = spark.conf.get(CLEANUP, "false")
            self.writers += 1
            spark.conf.set(CLEANUP, "true")
        try:
            yield
        finally:
            with self.lock:
                self.writers -= 1
                if not self.writers:
                    spark.conf.set(CLEANUP, self.before)


_cleanup = _Cleanup()


class Scratch:
    """Written tables of one operator call: lineage is cut by a table that survives lost executors.

    A table that nothing reads any more is dropped by its operator; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
        self.n = 0
        noted = _NOTED.get()
        if noted is not None:
            noted.append(self)

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def keep(self, df: DataFrame, **options) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        writer = df.write.option("compression", "zstd")
        for k, v in options.items():
            writer = writer.option(k, v)
        with _cleanup.on(self.spark):
            writer.parquet(path)
        if self.n == 1:
            fs, p = self._path(self.root)
            fs.deleteOnExit(p)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Remove tables that nothing lazy reads any more."""
        for f in frames:
            fs, p = self._path(f._scratch_path)
            fs.delete(p, True)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per context (they may not have it on their path)."""
    sc = spark.sparkContext
    if getattr(sc, "_finlattice_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp(prefix="finlattice-"))  # the driver serves it to the executors until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    to = folder / "finlattice.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(to))
    sc._finlattice_shipped = True


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(docs: DataFrame):
    """The text column as a string, whatever else the table holds."""
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def slices(offsets: np.ndarray, most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, each of one row at least."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def passes(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) in passes of bounded size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        for lo, hi in slices(offsets):
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def frugal(run: Callable) -> Callable:
    """`run` over Arrow batches, after which the worker hands freed memory back: idle workers live on."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return whole
