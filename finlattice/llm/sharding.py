"""Sharding by a two-pass external shuffle: scatter into memory-sized buckets, then Fisher-Yates in each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import Scratch, frugal, shuffle_parts

#: What a record needs besides its text.
RECORD_BYTES = 8
#: Groups of consecutive buckets: the driver adds up so many counts at most, whatever the input.
GROUPS = 4096


def settled(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, Column]:
    """`docs` as rows that are read alike each time, and a column that tells them apart (hash of the file, place in it).

    A plain scan of files, with columns or rows chosen, is settled as it is. Anything else (a join, an explode, a
    sample, rows of the driver) may hold one file row several times or come out in another order, and is written first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    ident = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:  # only Parquet tells a row's place
        placed = plan.getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in docs.columns and bool(docs.select(ident).schema)
    except AnalysisException:
        placed = False
    return (docs if placed else scratch.keep(docs)), ident


def number(text: Column, digits: int = 15) -> Column:
    """A whole number of `digits` hexadecimal digits that follows from the text alone."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def spotted(docs: DataFrame, columns: list[str], seed: int, scratch: Scratch) -> DataFrame:
    """`docs` and `spot`, a seeded number that follows from what a row holds in `columns`, wherever the row lies.

    Rows that hold the same (repeated rows) are told apart by their place in their file besides, so that even a
    table of equal rows spreads; which of them has which spot makes no difference. Columns are read as text, null apart
    from the empty text. The names `spot` and `content` must be free.
    """
    said = F.concat_ws("|", *(F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), F.md5(F.col(c).cast("string").cast("binary")))) for c in columns))
    docs, ident = settled(docs, scratch)
    docs = docs.withColumns({"content": said, "row": ident["row"]})
    again = scratch.keep(docs.groupBy(F.xxhash64("content").alias("twice")).count().where("count > 1").select("twice"))
    place = F.concat_ws("|", F.lit(str(seed)), F.col("content"))
    if again.limit(1).count():
        docs = docs.join(again, F.xxhash64("content") == F.col("twice"), "left")
        place = F.when(F.col("twice").isNull(), place).otherwise(F.concat_ws("|", place, "row"))
    return docs.withColumn("spot", number(place)).drop("content", "row", "twice")


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of 0..n-1 (numpy's permutation is a Fisher-Yates shuffle), the same for a seed and a bucket."""
    return np.random.Generator(np.random.PCG64([seed, bucket])).permutation(n)


def shuffled(docs: DataFrame, n_shards: int, seed: int = 17, bucket_bytes: int = 4 << 20) -> DataFrame:
    """Every row of `docs` (doc_id, text) with its shard and its slot there.

    Pass 1 sends each row to one of B buckets by a seeded hash of what it holds (see spotted); B makes a bucket
    about `bucket_bytes` large. Pass 2 sorts a bucket by that hash and Fisher-Yates shuffles it. Buckets follow each
    other, and shard s takes the rows of the shuffled order from floor(s * rows / n_shards) on: counts differ by one
    at most. Where a bucket begins is a table, joined by bucket; the driver gets GROUPS sums. Law `rows`. One seed
    gives one result for a table, whatever files it lies in. Null text: 0 bytes, kept as null. Empty table: no rows.
    A long text is one record; its bucket is as much larger. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = spotted(own, ["doc_id", "text"], seed, scratch)
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + RECORD_BYTES)).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    # the scatter is a prefix of the hash, the order within a bucket the rest of it
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("spot", 20), F.lit(buckets)))
    group = F.floor(F.col("bucket") * min(GROUPS, buckets) / buckets).cast("int")
    counts = scratch.keep(rows.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("group", group))
    sums = sorted(tuple(r) for r in counts.groupBy("group").agg(F.sum("n")).collect())
    ends = np.cumsum([n for _, n in sums]).tolist()
    total = ends[-1] if ends else 0
    base = spark.createDataFrame([(g, e - n) for (g, n), e in zip(sums, ends, strict=True)], "group int, base long")
    ahead = F.sum("n").over(Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.withColumn("ahead", F.coalesce(ahead, F.lit(0))).join(base, "group").select("bucket", (F.col("base") + F.col("ahead")).alias("begin"))
    edges = np.asarray([s * total // n_shards for s in range(n_shards + 1)])

    def place(batches):
        """One bucket after another; a task's rows come sorted by bucket and hash."""
        for table in _buckets(batches):
            bucket, begin, n = table.column("bucket")[0].as_py(), table.column("begin")[0].as_py(), table.num_rows
            to = begin + np.arange(n)
            shard = np.searchsorted(edges, to, side="right") - 1
            out = table.select(["doc_id", "text"]).take(pa.array(fisher_yates(n, seed, bucket)))
            out = out.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(to - edges[shard]))
            yield from out.combine_chunks().to_batches()

    parts = max(1, min(buckets, max(shuffle_parts(spark), -(-size // (64 << 20)))))
    dealt = rows.repartition(parts, "bucket").join(scratch.keep(begins), "bucket").sortWithinPartitions("bucket", "spot", "doc_id", "text")
    return dealt.select("doc_id", "text", "bucket", "begin").mapInArrow(frugal(place), "doc_id long, text string, shard int, slot long")


def _buckets(batches):
    """Tables of one bucket each, of batches sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi == lo:
                continue
            if held and held[0].column(2)[0].as_py() != int(keys[lo]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def write_shards(docs: DataFrame, n_shards: int, path: str, seed: int = 17, bucket_bytes: int = 4 << 20) -> DataFrame:
    """Write the shuffled rows to path/shard=N, each sorted by slot, and read them back."""
    placed = shuffled(docs, n_shards, seed, bucket_bytes)
    placed.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def digest(placed: DataFrame) -> DataFrame:
    """op2's columns of a placed table."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return placed.select(
        "doc_id", (F.octet_length(text).cast("long") + RECORD_BYTES).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
