"""Packing along a Hilbert curve: neighbouring documents by content follow each other in the sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T
from .sharding import spotted
from .tokens import Ids
from .work import Scratch, frugal, shuffle_parts, slices, text_of, utf8

#: Bytes of text that are tokenised at once: the more, the fewer words are merged twice.
TOKEN_PASS = 8 << 20
HASHED_DIMS, DIMS, BITS = 1024, 3, 10
#: Ranges at most: quantiles and sums that the driver gets.
MAX_RANGES = 1 << 16


def projection(vocabulary: int, seed: int) -> np.ndarray:
    """Per token id its row of: hash to HASHED_DIMS counters, then a Gaussian projection to DIMS."""
    gauss = np.random.Generator(np.random.PCG64(seed)).standard_normal((HASHED_DIMS, DIMS)).astype(np.float32)
    return gauss[(T.mix(np.arange(vocabulary, dtype=np.uint64) + np.uint64(seed)) % np.uint64(HASHED_DIMS)).astype(np.int64)]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole coordinates below 2 ** bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns, from the largest cube to the smallest
        p = q - 1
        for i in range(n):
            up = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] = np.where(up, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[n - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def order_key(xyz: np.ndarray, mean: np.ndarray, spread: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """Hilbert key of the standardised vector, then bits of the row's own hash, so that equal texts can be parted."""
    z = (xyz - mean) / spread
    cell = np.clip((1 << BITS) / (1 + np.exp(-1.7 * z)), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert(cell, BITS) << 32 | (spot & 0xFFFFFFFF)


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, seed: int, scratch: Scratch) -> DataFrame:
    """doc_id, spot, n_tokens, projected vector, ids (two bytes each if they fit) of every row, written."""
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    rows = spotted(own, ["doc_id", "text"], seed, scratch).select("doc_id", "spot", "text")

    def run(batches):
        ids = Ids.of(tokenizer_path)
        vocabulary = max(ids.tokenizer.get_vocab_size(), end_id + 1)
        table = projection(vocabulary, seed)
        kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
        for batch in batches:
            _, offsets = utf8(batch.column(2))
            for lo, hi in slices(offsets, TOKEN_PASS):
                rows = batch.slice(lo, hi - lo)
                flat, n = ids.ids(rows.column(2).to_pylist())
                edge = np.append(0, np.cumsum(n + 1))
                out = np.full(edge[-1], end_id, kind)
                inner = np.ones(edge[-1], bool)
                inner[edge[1:] - 1] = False
                out[inner] = flat
                xyz = np.stack([np.add.reduceat(table[out, d], edge[:-1]) for d in range(DIMS)], 1) / (n + 1)[:, None]
                blob = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(edge * kind().nbytes), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n + 1), *(pa.array(xyz[:, d].astype(np.float64)) for d in range(DIMS)), blob.cast(pa.binary()), pa.array(np.full(len(n), kind().nbytes, np.int32))], ["doc_id", "spot", "n_tokens", "x", "y", "z", "ids", "width"])

    return scratch.keep(rows.mapInArrow(frugal(run), "doc_id long, spot long, n_tokens long, x double, y double, z double, ids binary, width int"))


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, seed: int = 29, bucket_tokens: int = 4 << 20) -> DataFrame:
    """Pieces of documents in sequences of `length` ids: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Every row is tokenised whole and closed by `end_id` (null or empty text: that id alone). Counts of its ids,
    hashed and projected to three dimensions and standardised by the corpus, give a Hilbert key; rows are
    range-sorted by it and laid end to end, and the line is cut every `length` ids. So only the last sequence is
    not full. ids: little-endian unsigned 32-bit. Repeated rows are packed each; a long text runs through as many
    sequences as it needs; an empty table gives no rows; other columns are not read, whatever their names. Ranges
    come from approximate quantiles of the key; equal keys (exact copies) differ in their lower bits and so may be
    parted. The driver gets one sum per range of about `bucket_tokens` ids, of MAX_RANGES ranges at most: beyond
    that ranges grow, which are sorted by Spark's external sort and cut as a stream, so none must fit in memory.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    rows = tokenised(docs, tokenizer_path, end_id, seed, scratch)
    stats = rows.agg(F.sum("n_tokens"), *(f(c) for c in "xyz" for f in (F.avg, F.stddev_pop))).first()
    total = stats[0] or 0
    mean = np.asarray([stats[1], stats[3], stats[5]], float) if total else np.zeros(3)
    spread = np.maximum(np.asarray([stats[2], stats[4], stats[6]], float), 1e-9) if total else np.ones(3)
    parts = max(shuffle_parts(spark), min(MAX_RANGES, -(-total // bucket_tokens)), 1)

    def keyed(batches):
        for b in batches:
            xyz = np.stack([b.column(c).to_numpy() for c in "xyz"], 1)
            key = order_key(xyz, mean, spread, b.column("spot").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n_tokens", "width", "ids") if c in b.schema.names), pa.array(key)], [*(c for c in ("doc_id", "n_tokens", "width", "ids") if c in b.schema.names), "key"])

    narrow = scratch.keep(rows.select("n_tokens", "spot", "x", "y", "z").mapInArrow(frugal(keyed), "n_tokens long, key long"))
    cuts = narrow.agg(F.percentile_approx("key", F.array(*(F.lit(i / parts) for i in range(1, parts))) if parts > 1 else F.array(F.lit(0.5)), F.lit(max(10000, 4 * parts)))).first()[0] or []
    bounds = np.unique(np.asarray(cuts if parts > 1 else [], np.int64))

    def ranged(batches):
        for b in batches:
            at = np.searchsorted(bounds, b.column("key").to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], [*b.schema.names, "range"])

    sums = dict(narrow.mapInArrow(frugal(ranged), "n_tokens long, key long, range int").groupBy("range").agg(F.sum("n_tokens")).collect())
    base, at = {}, 0
    for r in range(len(bounds) + 1):
        base[r] = at
        at += sums.get(r, 0)

    def cut(batches):
        to = None
        for b in batches:
            if to is None:
                to = base[b.column("range")[0].as_py()]
            n, width = b.column("n_tokens").to_numpy(), b.column("width")[0].as_py()
            blob = b.column("ids")
            _, off, data = blob.buffers()
            off = np.frombuffer(off, np.int32)[blob.offset : blob.offset + len(blob) + 1]
            ids = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(np.uint16 if width == 2 else np.uint32).astype("<u4")
            begin = to + np.cumsum(n) - n
            to += int(n.sum())
            pieces = (begin + n - 1) // length - begin // length + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            lo = np.where(k == 0, begin[doc], (begin[doc] // length + k) * length)
            hi = np.minimum(begin[doc] + n[doc], (lo // length + 1) * length)
            edge = np.append(lo - begin[0], to - begin[0]) * 4
            out = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(lo - begin[doc]), pa.array(hi - lo), out, pa.array(n[doc]), pa.array(lo // length), pa.array(lo % length)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    full = rows.mapInArrow(frugal(lambda batches: ranged(keyed(batches))), "doc_id long, n_tokens long, width int, ids binary, key long, range int")
    dealt = full.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("key", "doc_id", "n_tokens", "ids")
    return dealt.mapInArrow(frugal(cut), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    """op3's columns of packed pieces."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
