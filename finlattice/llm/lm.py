"""Stupid-backoff scores: count tables by hash partition, joined to the n-grams of all texts, summed per document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T
from .work import Scratch, frugal, shuffle_parts, slices, text_of, utf8

BACKOFF = 0.4


def squeeze(x: np.ndarray) -> bytes:
    """64-bit numbers: how many, then their byte planes, compressed (planes of zeros take no room)."""
    planes = np.ascontiguousarray(x).view(np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def expand(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").reshape(n).view(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted whole 64-bit keys by their steps, of which the high bytes are zeros."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(expand(raw).view(np.uint64), dtype=np.uint64)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Partitions are ranges of the hash, so that a partition's keys are near each other."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Chunk:
    """Some texts as word hashes; `left[n]`: per position, how often other texts hold the n-gram that ends there."""

    def __init__(self, row: dict):
        self.row = row
        self.first = np.append(0, np.cumsum(np.asarray(row["sizes"], np.int64))).astype(np.int64)
        self.vocabulary, self.index = np.frombuffer(row["vocabulary"], np.uint64), expand(row["words"])
        self.words = self.vocabulary[self.index]
        self.doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.left = {n: expand(row[f"left{n}"]) for n in range(2, 99) if row.get(f"left{n}")}
        if row.get("left1"):  # of words it is enough to keep the count of each in the vocabulary
            self.tell_words(expand(row["left1"]))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams that others may hold, in order; the place in them of each such position; these positions.

        Others hold an n-gram only if they hold what it begins and what it ends with, so the rest needn't be asked for.
        """
        if n == 1:
            keys, back = self.word_keys()
            return keys, back[self.index], np.arange(len(self.words))
        at, h = T.windows(self.words, self.first, n)
        end = at + n - 1
        able = (self.left[n - 1][end] > 0) & (self.left[n - 1][end - 1] > 0)
        end, h = end[able], h[able]
        keys, back = np.unique(h ^ np.uint64(n), return_inverse=True)
        return keys, back, end

    def word_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the vocabulary, in order, and the place of each word in them."""
        _, h = T.windows(self.vocabulary, np.asarray([0, len(self.vocabulary)]), 1)
        return np.unique(h ^ np.uint64(1), return_inverse=True)

    def tell_words(self, counts: np.ndarray) -> None:
        """counts: of each word of the vocabulary, in the corpus."""
        self.left[1] = counts[self.index] - self.own(self.index, len(counts))

    def own(self, number: np.ndarray, below: int, at: np.ndarray | None = None) -> np.ndarray:
        """How often a text itself holds what stands at each position (a number below `below`)."""
        doc = self.doc if at is None else self.doc[at]
        _, back, times = np.unique(doc * np.int64(max(below, 1)) + number, return_inverse=True, return_counts=True)
        return times[back]

    def ask(self, n: int, parts: int):
        """Partition, keys and own counts of the distinct n-grams, a row per partition."""
        keys, back, _ = self.grams(n)
        if not len(keys):
            return
        count, part = np.bincount(back), part_of(keys, parts)
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.append(cut[1:], len(part))
        yield pa.RecordBatch.from_arrays([
            pa.array(part[cut].astype(np.int32)), pa.array(np.full(len(cut), self.row["chunk"], np.int64)),
            pa.array([pack_keys(keys[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary()), pa.array([squeeze(count[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary()),
        ], ["part", "chunk", "keys", "counts"])

    def hear(self, n: int, sums: list[bytes]) -> bytes:
        """Turn the corpus counts of the asked n-grams, partition by partition, into what other texts hold; what to keep of it."""
        counts = np.concatenate([expand(x) for x in sums]) if sums else np.zeros(0, np.int64)
        if n == 1:
            counts = counts[self.word_keys()[1]]
            self.tell_words(counts)
            return squeeze(counts)
        _, back, end = self.grams(n)
        self.left[n] = np.zeros(len(self.words), np.int64)
        if len(end):
            self.left[n][end] = counts[back] - self.own(back, len(counts), end)
        return squeeze(self.left[n])

    def scores(self, total: int) -> np.ndarray:
        """Per text, the sum of log10 scores of its words."""
        size, orders = np.diff(self.first), max(self.left)
        others = (total - size)[self.doc]
        # from the unigram up: the highest order that others have wins
        score = np.log10(np.maximum(self.left[1], 0.5) / np.maximum(others, 1)) + (orders - 1) * np.log10(BACKOFF)
        for n in range(2, orders + 1):
            hit = np.flatnonzero(self.left[n] > 0)
            here, context = self.left[n][hit], self.left[n - 1][hit - 1]
            score[hit] = np.log10(here / np.maximum(context, here)) + (orders - n) * np.log10(BACKOFF)
        sums, some = np.zeros(len(size)), size > 0
        if len(score):
            sums[some] = np.add.reduceat(score, self.first[:-1][some])  # each text by itself: a running sum would lose digits
        return sums


#: A chunk: its texts' ids and word counts, its distinct words (hashes, frequent ones first), its words as numbers of these.
CHUNK = "chunk long, doc_ids array<long>, sizes array<long>, vocabulary binary, words binary, n long"
_FIELDS = [f.split(" ")[0] for f in CHUNK.split(", ")]


def backoff_scores(docs: DataFrame, order: int = 3, chunk_bytes: int = 8 << 20, part_words: int = 2 << 20) -> DataFrame:
    """doc_id, n_words, log10_sum, log10_mean of every row, scored by the n-gram counts of all other rows.

    Stupid backoff up to `order`: count(n-gram) / count(its first n - 1 words) if other texts have the n-gram, else
    0.4 times the score of the next lower order; an unseen word counts half. Texts are cut into words at white
    space and gathered in chunks. Order by order, the n-grams of each chunk are exploded, counted within the
    chunk and dealt by hash to partitions, in rows of one chunk and one partition; a partition sums them to its
    count table, joins the table to what came in and sends the counts back. So a frequent n-gram is one entry per
    chunk, whatever its share. An n-gram is asked for only where others hold both n-grams of the order below in it.
    Keys are whole 64-bit hashes, sums 64-bit numbers. Work and rows grow with the n-grams: a row holds the many
    that a chunk has in a partition, and one at worst. Each order is a written table; its shuffle is gone before the next.
    Null or empty text: 0 words, sum 0, null mean. A long text is a chunk of its own. Repeated rows score each
    other. Other columns are not read, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))

    def write(batches):
        here, k = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part, data, offsets in _sized(batch, chunk_bytes):
                w = T.words(data, offsets)
                vocabulary, index, often = np.unique(w.hashes(), return_inverse=True, return_counts=True)
                by = np.argsort(-often, kind="stable")  # frequent words get small numbers
                vocabulary, index = vocabulary[by], np.argsort(by)[index]
                yield _chunk({"chunk": here + k, "doc_ids": part.column("doc_id").to_pylist(), "sizes": w.counts.tolist(), "vocabulary": vocabulary.tobytes(), "words": squeeze(index), "n": len(index)})
                k += 1

    chunks = scratch.keep(rows.mapInArrow(frugal(write), CHUNK))
    total = chunks.agg(F.sum("n")).first()[0] or 0
    parts = max(shuffle_parts(spark), -(-total // part_words))

    lefts: dict[int, DataFrame] = {}  # per order, what other texts hold at each position of a chunk

    def known(*orders: int) -> DataFrame:
        out = chunks
        for n in orders:
            out = out.join(lefts[n], "chunk") if n else out
        return out

    for n in range(1, order + 1):

        def ask(batches, n=n):
            for row in _rows(batches):
                yield from Chunk(row).ask(n, parts)

        def hear(batches, n=n):
            for row in _rows(batches):
                c = Chunk(row)
                kept = c.hear(n, [x["sums"] for x in row["told"] or []])
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]]), pa.array([kept], pa.binary())], ["chunk", f"left{n}"])

        def score(batches, n=n):
            for row in _rows(batches):
                c = Chunk(row)
                c.hear(n, [x["sums"] for x in row["told"] or []])
                size = np.diff(c.first)
                sums = c.scores(total) if len(c.words) else np.zeros(len(size))
                mean = pa.array(sums / np.maximum(size, 1), mask=size == 0)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(size), pa.array(sums), mean], ["doc_id", "n_words", "log10_sum", "log10_mean"])

        asked = known(n - 1).mapInArrow(frugal(ask), "part int, chunk long, keys binary, counts binary")
        told = scratch.keep(asked.repartitionById(parts, F.col("part")).mapInArrow(frugal(count_table), "chunk long, part int, sums binary"))
        answers = told.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "sums"))).alias("told"))
        if n == order:
            return known(*range(1, n)).join(answers, "chunk", "left").mapInArrow(frugal(score), "doc_id long, n_words long, log10_sum double, log10_mean double")
        lefts[n] = scratch.keep(known(n - 1).join(answers, "chunk", "left").mapInArrow(frugal(hear), f"chunk long, left{n} binary"))
        scratch.drop(told)
    raise ValueError("order must be 1 or more")


def count_table(batches):
    """The count table of each n-gram partition of this task, joined to what each chunk asked for."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    for part in np.unique(t.column("part").to_numpy()).tolist():
        own = t.filter(pc.equal(t.column("part"), part))
        keys = [unpack_keys(x) for x in own.column("keys").to_pylist()]
        counts = np.concatenate([expand(x) for x in own.column("counts").to_pylist()])
        table, back = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(table), np.int64)
        np.add.at(sums, back, counts)
        sums, edge = sums[back], np.append(0, np.cumsum([len(k) for k in keys]))
        out = [squeeze(sums[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([own.column("chunk").combine_chunks(), pa.array([part] * len(out), pa.int32()), pa.array(out, pa.binary())], ["chunk", "part", "sums"])


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _chunk(row: dict) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([row[f]], k) for f, k in zip(_FIELDS, kinds, strict=True)], _FIELDS)


def _sized(batch: pa.RecordBatch, most: int):
    data, offsets = utf8(batch.column(1))
    for lo, hi in slices(offsets, most):
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
