"""Near-duplicate classes by min-max hashing: both ends of each permutation, banded, links confirmed on full sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T
from .work import Scratch, frugal, passes, text_of

#: A band joins the minimum and the maximum of PER_BAND permutations: 2 * PER_BAND values. At a Jaccard
#: similarity of 0.8 a pair shares one band at least but for (1 - 0.8 ** 6) ** 42 = 3e-6 of pairs.
BANDS, PER_BAND = 42, 3
_PERM = np.random.Generator(np.random.PCG64(6151)).integers(0, 1 << 63, (BANDS * PER_BAND, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of k-word shingles, sorted within each text; the text of each; how many each text has.

    A-Z count as a-z. A text of fewer than k words has its whole sequence as one shingle; one without words none.
    """
    w = T.words(T.LOWER[data], offsets)
    h = w.hashes()
    roll = T.word_roller(h)
    at, shingle = T.windows(h, w.first, k, roll)
    doc = w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        shingle = np.append(shingle, roll.ranges(w.first[short], w.first[short + 1]))
        doc = np.append(doc, short)
    by = np.lexsort((shingle, doc))
    shingle, doc = shingle[by], doc[by]
    new = np.ones(len(by), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
    shingle, doc = shingle[new], doc[new]
    return shingle, doc, np.bincount(doc, minlength=len(offsets) - 1)


def signatures(shingle: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Band keys (texts x BANDS) of the sets that begin at `begin`."""
    out = np.empty((len(begin), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            key = np.full(len(begin), b + 1, np.uint64)
            for a, c in _PERM[b * PER_BAND : (b + 1) * PER_BAND]:
                v = shingle * a + c
                key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(v, begin))
                key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.maximum.reduceat(v, begin))
            out[:, b] = key
    return out


#: Longs of a set's parity bitmap.
PARITY = 16


def parities(shingle: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Bitmaps (texts x PARITY longs) in which each shingle of a set turns over the bit of its hash.

    Two bitmaps differ in no more bits than their sets have elements that the other lacks.
    """
    out = np.zeros((docs, PARITY), np.int64)
    edge = np.searchsorted(doc, np.arange(0, docs + 2048, 2048))
    for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
        lo, n = k * 2048, min(2048, docs - k * 2048)
        if n > 0:
            at = (doc[a:b] - lo) * (64 * PARITY) + (shingle[a:b] % np.uint64(64 * PARITY)).astype(np.int64)
            bits = (np.bincount(at, minlength=n * 64 * PARITY) & 1).astype(np.uint8)
            out[lo : lo + n] = np.packbits(bits.reshape(n, -1), axis=1).view(np.int64)
    return out


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, set size, a digest of the whole set (128 bits, collision-resistant), band keys (none of an empty set)."""
    def run(batches):
        for rows, data, offsets in passes(batches):
            shingle, doc, n = shingle_sets(data, offsets, k)
            parity = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * PARITY + 1, PARITY, dtype=np.int32)), pa.array(parities(shingle, doc, len(n)).ravel()))
            full = n > 0
            begin = (np.cumsum(n) - n)[full]
            bands = np.zeros((len(n), BANDS), np.uint64)
            names = np.zeros((len(n), 2), np.uint64)
            if len(begin):
                bands[full] = signatures(shingle, begin)
                raw = memoryview(np.ascontiguousarray(shingle)).cast("B")
                digests = b"".join(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(begin.tolist(), (begin + n[full]).tolist(), strict=True))
                names[full] = np.frombuffer(digests, np.uint64).reshape(-1, 2)
            edge = np.append(0, np.cumsum(np.where(full, BANDS, 0))).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(edge), pa.array(bands[full].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n.astype(np.int64)), *(pa.array(np.ascontiguousarray(names[:, i]).view(np.int64)) for i in range(2)), keys, parity], ["doc_id", "n", "s1", "s2", "bands", "parity"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(frugal(run), "doc_id long, n long, s1 long, s2 long, bands array<long>, parity array<long>")


def linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets meet 100 * intersection >= percent * union."""
    ta = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    tb = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches):
        for batch in batches:
            for rows, data, offsets in passes([batch], "text_a"):
                h1, d1, n1 = shingle_sets(data, offsets, k)
                for part, data, offsets in passes([rows.append_column("row", pa.array(np.arange(rows.num_rows)))], "text_b"):
                    h2, d2, n2 = shingle_sets(data, offsets, k)
                    row = part.column("row").to_numpy()
                    own = (d1 >= row[0]) & (d1 <= row[-1])
                    h, d = np.append(h1[own], h2), np.append(d1[own] - row[0], d2)
                    by = np.lexsort((h, d))
                    h, d = h[by], d[by]
                    both = np.bincount(d[1:][(h[1:] == h[:-1]) & (d[1:] == d[:-1])], minlength=len(row)) if len(h) else np.zeros(len(row), np.int64)
                    yield part.select(["a", "b"]).filter(pa.array(100 * both >= percent * (n1[row] + n2 - both)))

    return pairs.join(ta, "a").select("a", "b", "text_a").join(tb, "b").select("a", "b", "text_a", "text_b").mapInArrow(frugal(run), "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component: smallest node reachable, for every node on an edge (a, b).

    Large-star and small-star steps in turn; each halves the depth of the trees and keeps no more rows than
    there are edges. Every step is written, so a lost executor costs one step; so are the smallest neighbours, which
    are joined as tables, so that Spark can split the edges of a hub among tasks.
    """
    edges = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    size = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = scratch.keep(both.join(first, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        second = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(second, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = scratch.keep(small)
        now = tuple(small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(edges, first, large, second)
        edges = small
        if now == size:
            break
        size = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, k: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of `docs`.

    Two documents are linked if their sets of k-word shingles have 100 * intersection >= percent * union; a
    component is named by its smallest doc_id. Sets with equal digests (128 bits of the whole sorted set) are one
    node from the start, so copies cost nothing later. In each bucket of equal band keys every node is paired with the
    bucket's smallest and largest node only; the pairs are confirmed on full sets and joined to components. Buckets
    that still hold several components then pair their members outside the bucket's largest component with all
    members of other components, so that no candidate link between components is left untried, while groups that are
    one component never emit all their pairs; bitmaps that bound the difference of two sets from below rule out
    pairs without loss before they are emitted. What is joined by band key is a written table on both sides, so that
    Spark splits a hot bucket among tasks. Empty documents (null text, no words) and null ids stand alone. Rows
    that share a doc_id are one node. A long text is one set, whatever its size. Other columns are not read, whatever
    their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    sig = scratch.keep(signed(docs, k))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    named = sig.where("n > 0 and doc_id is not null")
    classes = scratch.keep(named.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node")))
    reps = named.join(classes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    banded = scratch.keep(reps.select(F.col("doc_id").alias("node"), "n", F.explode("bands").alias("key")))
    member = F.struct("node", "n")
    ends = scratch.keep(banded.groupBy("key").agg(F.min(member).alias("lo"), F.max(member).alias("hi")).where("lo.node < hi.node"))
    near = banded.join(ends, "key").select("node", "n", F.explode(F.array("lo", "hi")).alias("x")).select("node", "n", F.col("x.node").alias("other"), F.col("x.n").alias("m"))
    fits = F.expr(f"node <> other and 100 * least(n, m) >= {percent} * greatest(n, m)")
    pairs = scratch.keep(near.where(fits).select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct())
    edges = scratch.keep(linked(pairs, texts, k, percent))
    found = components(edges, scratch)
    # buckets that are not yet one component
    at = scratch.keep(banded.join(ends.select("key"), "key", "left_semi").join(found, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("c")))
    split = scratch.keep(at.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key"))
    scratch.drop(banded, ends)
    open_ = at.join(split, "key").join(reps.select(F.col("doc_id").alias("node"), "n", "parity").distinct(), ["node", "n"])
    open_ = scratch.keep(open_)
    sizes = open_.groupBy("key", "c").agg(F.count("*").alias("size"))
    major = scratch.keep(sizes.groupBy("key").agg(F.max_by("c", F.struct("size", "c")).alias("major")))
    minor = open_.join(major, "key").where("c <> major").select("key", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("c").alias("cx"), F.col("parity").alias("px"))
    minor = scratch.keep(minor)
    # a link needs (100 + percent) * (elements of one set only) <= (100 - percent) * (n + nx): bitmaps that differ more rule it out
    differ = "aggregate(zip_with(parity, px, (a, b) -> bit_count(a ^ b)), 0, (s, x) -> s + x)"
    close = F.expr(f"100 * least(n, nx) >= {percent} * greatest(n, nx) and {100 + percent} * {differ} <= {100 - percent} * (n + nx)")
    more = minor.join(open_, "key").where("c <> cx").where(close)
    more = more.select(F.greatest("x", "node").alias("a"), F.least("x", "node").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    more = scratch.keep(more)
    late = scratch.keep(linked(more, texts, k, percent))
    scratch.drop(at, split, open_, major, minor, more, pairs)
    if late.limit(1).count():
        found = components(edges.unionByName(late), scratch)
    named_class = classes.join(found, "node", "left").select("s1", "s2", "n", F.coalesce("component", "node").alias("component_id"))
    out = sig.join(named_class, ["s1", "s2", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
