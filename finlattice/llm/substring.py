"""Substring dedup: texts are factored greedily against reference blocks indexed by phrases; long factors go."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T
from .sharding import settled
from .work import Scratch, frugal, passes, text_of

#: Words of the phrase by which the reference is indexed.
PHRASE = 8
#: Distinct passages under one phrase that a block compares with each other; phrases with more are looked up window by window.
MAX_KINDS = 256
#: Pairs of passages that are compared at once.
PAIRS = 1 << 16
#: A marked passage (phrase, where it stands in it, its words) or a window (its hash) of a text.
PIECES = "phrase long, t1 long, t2 long, lo int, anchor int, words binary, h1 long, h2 int, times long"
#: The identity of a row.
SPOT = "spot struct<file:long,row:long>"


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest of each w consecutive values, the leftmost of equal ones."""
    n = len(values)
    bits = max(1, int(n).bit_length())
    key = (values >> np.uint64(bits)) << np.uint64(bits) | np.arange(n, dtype=np.uint64)
    pad = -n % w
    blocks = np.append(key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, w)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    best = np.minimum(right[: n - w + 1], left[w - 1 : n])
    return (best & np.uint64((1 << bits) - 1)).astype(np.int64)


class Parse:
    """Words of the texts in one pass, their windows of `length` words and the phrase that stands for each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.words = w = T.words(data, offsets)
        self.length = length
        self.hashes = w.hashes()
        self.roll = T.word_roller(self.hashes)
        self.check = checker(self.hashes)
        self.at, _ = T.windows(self.hashes, w.first, length, self.roll)
        self.at = self.at.astype(np.int64)
        if len(self.at):
            starts = np.arange(len(self.hashes) - PHRASE + 1)
            phrase = self.roll.ranges(starts, starts + PHRASE)
            anchor = sliding_argmin(phrase, length - PHRASE + 1)[self.at]
            # windows of one text with one anchor stand together: a factor candidate
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (w.doc[self.at][1:] != w.doc[self.at][:-1])
            self.begin = np.flatnonzero(new)
            self.anchor = anchor[self.begin]
            self.key = phrase[self.anchor]
        else:
            self.begin = self.anchor = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
        last = np.append(self.begin[1:], len(self.at)) - 1
        self.lo = self.at[self.begin]  # first word of the factor candidate
        self.hi = (self.at[last] + length) if len(self.at) else self.lo  # word after its last
        self.doc = w.doc[self.lo] if len(self.at) else self.lo

    def factor_hash(self) -> np.ndarray:
        """Names the words of a candidate and where the phrase stands in it."""
        return T.mix(self.check.ranges(self.lo, self.hi) + (self.anchor - self.lo).astype(np.uint64))

    def keep(self, own: np.ndarray) -> None:
        """Only these candidates."""
        self.key, self.anchor, self.lo, self.hi, self.doc = self.key[own], self.anchor[own], self.lo[own], self.hi[own], self.doc[own]

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        return named_by(self.words, self.roll, self.check)


def named_by(w: T.Words, roll: T.Roller, check: T.Roller) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's words."""
    lo, hi = w.first[:-1], w.first[1:]
    return roll.ranges(lo, hi), check.ranges(lo, hi)


def checker(hashes: np.ndarray) -> T.Roller:
    """A second, independent hash of word sequences."""
    return T.Roller(T.mix(hashes + np.uint64(0x5851F42D4C957F2D)), T._BASE)


def names_of(w: T.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return named_by(w, T.word_roller(hashes), checker(hashes))


_signed = lambda x: pa.array(x.view(np.int64))


def aligned(words: list[bytes], anchor: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Words (hashes) of passages before and after the phrase at `anchor`, from it outward; where there is none, numbers that no other has."""
    n = len(words)
    left, right = ((np.arange(n * reach, dtype=np.uint64) + np.uint64(1 << 63) + np.uint64(k * n * reach)).reshape(n, reach) for k in range(2))
    for i, (w, a) in enumerate(zip(words, anchor.tolist(), strict=True)):
        h = np.frombuffer(w, np.uint64) >> np.uint64(1)
        before, after = h[:a][::-1][:reach], h[a + PHRASE :][:reach]
        left[i, : len(before)], right[i, : len(after)] = before, after
    return left, right


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many columns from the first on are equal."""
    return np.minimum.accumulate(a == b, 1).sum(1)


def factored(group: np.ndarray, words: list[bytes], anchor: np.ndarray, length: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of each wanted passage relative to the others of its group: passage, first word, word after the last, the other passage.

    Passages of a group have one phrase in common, at `anchor`. A factor is the longest run of words around it that
    another passage has too, if it has `length` words; so half of the words that it needs beside the phrase are equal on
    one side at least, and only passages that agree there are compared. From the first word on the longest factor is taken, then, at the
    end of each, the longest one that begins before that boundary and reaches over it: so every window of `length`
    words that another passage holds lies in a factor.
    """
    left, right = aligned(words, anchor, length - PHRASE)
    half, out = -(-(length - PHRASE) // 2), []
    for side in (left, right):
        key = T.mix(group.view(np.uint64))
        with np.errstate(over="ignore"):
            for c in range(half):
                key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + side[:, c])
        by = np.argsort(key, kind="stable")
        begin = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1]))
        size = np.diff(np.append(begin, len(by)))
        first, n = np.repeat(begin, size), np.where(wanted[by], np.repeat(size, size), 0)  # per passage, those that agree
        ends, lo = np.cumsum(n), 0
        while lo < len(by):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
            i = np.repeat(np.arange(lo, hi), n[lo:hi])
            j = np.arange(len(i)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi]) + first[i]
            i, j = by[i[i != j]], by[j[i != j]]
            before, after = common(left[i], left[j]), common(right[i], right[j])
            long = before + PHRASE + after >= length
            out.append((i[long], (anchor[i] - before)[long], (anchor[i] + PHRASE + after)[long], j[long]))
            lo = hi
    i, start, end, j = (np.concatenate(x) for x in zip(*out, strict=True))
    by = np.lexsort((-end, start, i))
    i, start, end, j = i[by], start[by], end[by], j[by]
    # beyond all that begins earlier in the same passage: offsets keep passages apart
    reach = np.maximum.accumulate(end + i * np.int64(1 << 20))
    keep = np.append(True, (end + i * np.int64(1 << 20))[1:] > reach[:-1]) if len(i) else np.zeros(0, bool)
    return i[keep], start[keep], end[keep], j[keep]


def _phrases(batches, most: int):
    """Tables of whole phrases, of `most` rows or one phrase, of batches sorted by phrase."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if n >= most:
            same = int((key != held[-1].column(0)[-1].as_py()).argmax()) if key[-1] != held[-1].column(0)[-1].as_py() else len(key)
            if same:
                held.append(batch.slice(0, same))
            if same < len(key):
                yield pa.Table.from_batches(held)
                held, n, batch = [], 0, batch.slice(same)
            else:
                continue
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def factors(docs: DataFrame, length: int = 35) -> DataFrame:
    """doc_id, start, size: the duplicate spans of each row, in words; they may overlap. An equal twin makes a long enough text one factor."""
    return _parsed(docs, length)[1]


def deduplicated(docs: DataFrame, length: int = 35) -> DataFrame:
    """Each row with its kept words: doc_id, n_words, n_removed, kept_text.

    A word goes if a window of `length` consecutive words of its text that covers it also starts anywhere else,
    same text included; so every copy of a repeated passage goes, the first too. Null text: no words.

    The reference is the corpus itself, in blocks. Each window is indexed under its smallest phrase of 8 words by
    hash; consecutive windows under one phrase form a passage, and passages are dealt to blocks by the phrase. A text
    meets the blocks that index its phrases, which are all that can hold a window of it. A passage that stands whole
    elsewhere is one factor. Where its phrase has other passages, it is factored greedily against those of the
    block (see factored): the longest factor from its first word on, then, at each factor's boundary, the longest one across it. The
    passages of a phrase that has more than MAX_KINDS of them are too many for one block; each of their windows is
    looked up by its hash instead, which finds the same. Equality is that of hashes (63 bits for each word of a
    factor, 96 bits of a window). Texts with an equal twin go at once, if they are long enough. A passage's copies
    are counted before they are shuffled, so a phrase in a third of all texts is as many rows as tasks. Repeated
    rows count as copies of each other; ids may repeat or be null; a long text is parsed whole; an empty table gives
    no rows; other columns are not read, whatever their names.
    """
    return _parsed(docs, length)[0]


def _parsed(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """deduplicated() and factors(), from one parse."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    own, ident = settled(own, scratch)
    rows = own.select("doc_id", "text", ident.alias("spot"))

    def name(batches):
        for part, data, offsets in passes(batches):
            w = T.words(data, offsets)
            a, b = names_of(w, w.hashes())
            yield pa.RecordBatch.from_arrays([_signed(a), _signed(b), part.column("spot"), pa.array(w.counts)], ["t1", "t2", "spot", "n"])

    def passage(batches):
        """Counted over a task's share of the texts before anything is shuffled."""
        for part, data, offsets in passes(batches):
            p = Parse(data, offsets, length)
            a, b = p.names()
            _, one, back, times = np.unique(a, return_index=True, return_inverse=True, return_counts=True)
            own = (one[back] == np.arange(len(a)))[p.doc]
            p.keep(own)
            yield pa.RecordBatch.from_arrays([_signed(p.key), _signed(p.factor_hash()), _signed(a[p.doc]), _signed(b[p.doc]), pa.array((p.lo - p.words.first[p.doc]).astype(np.int32)), pa.array((p.hi - p.lo).astype(np.int32)), pa.array(times[back][p.doc].astype(np.int64))], ["phrase", "factor", "t1", "t2", "lo", "size", "times"])

    names = rows.select("text", "spot").mapInArrow(frugal(name), f"t1 long, t2 long, {SPOT}, n long").groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min("spot").alias("spot"))
    names = scratch.keep(names)
    twins = names.where("copies > 1").select("t1", "t2")
    found = scratch.keep(rows.select("text").mapInArrow(frugal(passage), "phrase long, factor long, t1 long, t2 long, lo int, size int, times long"))
    # one row per distinct passage: how often, and one place where it stands
    distinct = found.groupBy("phrase", "factor").agg(F.sum("times").alias("times"), F.min("t1").alias("t1"))
    distinct = scratch.keep(distinct)
    known = distinct.groupBy("phrase").agg(F.count("*").alias("kinds"), F.sum("times").alias("times")).where("times > 1")
    whole = distinct.where("times > 1").select("phrase", "factor")
    several = scratch.keep(known.where("kinds > 1").select("phrase", (F.col("kinds") > MAX_KINDS).alias("hot")))
    spans = found.join(whole, ["phrase", "factor"], "left_semi").select("t1", "t2", "lo", "size")
    # passages that stand once under a known phrase, and one copy of those that stand more often there
    edge = distinct.join(several, "phrase")
    places = found.join(edge.select("phrase", "factor", "t1", (F.col("times") > 1).alias("often"), "hot"), ["phrase", "factor", "t1"]).select("t1", "t2", "lo", "size", "often", "hot").distinct()
    flagged = places.groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "size", "often", "hot")).alias("marks"))
    flagged = flagged.join(names.select("t1", "t2", "spot"), ["t1", "t2"])  # one row of each text

    def look(batches):
        """The marked passages: words of those that a block compares, window hashes of the others; rows: text, marks, t1, t2."""
        for batch in batches:
            marks = batch.column(batch.schema.get_field_index("marks"))
            for part, data, offsets in passes([batch.append_column("row", pa.array(np.arange(batch.num_rows)))]):
                p = Parse(data, offsets, length)
                words, kept, looked = p.hashes.tobytes(), [], []
                for i, row in enumerate(part.column("row").to_pylist()):
                    own = marks.slice(row, 1).flatten()
                    lo, size, often, hot = (own.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                    uniq = np.unique(lo, return_index=True)[1]
                    lo, size, times, hot = lo[uniq].astype(np.int64), size[uniq].astype(np.int64), np.where(often[uniq], 2, 1), hot[uniq].astype(bool)
                    kept.append(np.stack([np.full(len(lo), i), lo, size, times])[:, ~hot])
                    n = size[hot] - length + 1
                    start = np.repeat(lo[hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    looked.append(np.stack([np.full(len(start), i), start, np.repeat(times[hot], n)]))
                i, lo, size, times = np.concatenate(kept, 1)
                at = p.words.first[i] + lo
                mine = np.searchsorted(p.lo, at)  # passages begin in order
                yield _pieces(part, i, phrase=_signed(p.key[mine]), lo=lo, anchor=p.anchor[mine] - at, words=[words[8 * x : 8 * y] for x, y in zip(at.tolist(), (at + size).tolist(), strict=True)], times=times)
                i, lo, times = np.concatenate(looked, 1)
                at = p.words.first[i] + lo
                yield _pieces(part, i, lo=lo, h1=_signed(p.roll.ranges(at, at + length)), h2=(p.check.ranges(at, at + length) >> np.uint64(33)).astype(np.int32), times=times)

    def named(batches):
        for part, data, offsets in passes(batches):
            w = T.words(data, offsets)
            a, b = names_of(w, w.hashes())
            yield pa.RecordBatch.from_arrays([*part.columns, _signed(a), _signed(b)], [*part.schema.names, "t1", "t2"])

    texts = rows.mapInArrow(frugal(named), f"doc_id long, text string, {SPOT}, t1 long, t2 long")
    marked = rows.select("text", "spot").join(flagged, "spot")
    pieces = scratch.keep(marked.select("text", "marks", "t1", "t2").mapInArrow(frugal(look), PIECES))

    def parse(batches):
        """Factors of the passages that aren't known as a whole, phrase by phrase of a block."""
        for table in _phrases(batches, 1 << 14):
            table = table.combine_chunks()
            once = table.column("times").to_numpy() == 1
            i, start, end, _ = factored(table.column("phrase").to_numpy(), table.column("words").to_pylist(), table.column("anchor").to_numpy().astype(np.int64), length, once)
            if len(i):
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays([table.column("t1").combine_chunks().take(at), table.column("t2").combine_chunks().take(at), pa.array((table.column("lo").to_numpy()[i] + start).astype(np.int32)), pa.array((end - start).astype(np.int32))], ["t1", "t2", "lo", "size"])

    block = pieces.where("words is not null").select("phrase", "t1", "t2", "lo", "anchor", "words", "times")
    block = block.repartition("phrase").sortWithinPartitions("phrase", "t1", "t2", "lo").mapInArrow(frugal(parse), "t1 long, t2 long, lo int, size int")
    windows = pieces.where("words is null")
    # a written table: Spark then splits the windows of a hot hash among tasks
    repeated = scratch.keep(windows.groupBy("h1", "h2").agg(F.sum("times").alias("times")).where("times > 1").select("h1", "h2"))
    ends = windows.where("times = 1").join(repeated, ["h1", "h2"], "left_semi").select("t1", "t2", "lo", F.lit(length).alias("size"))
    ends = ends.unionByName(block)
    drop = spans.unionByName(ends).join(twins, ["t1", "t2"], "left_anti")
    drop = drop.groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "size")).alias("drop"))
    drop = drop.unionByName(twins.select("t1", "t2", F.expr("array(named_struct('lo', -1, 'size', 0))").alias("drop")))

    def cut(batches):
        """Greedy parse of each text into factors that go and words that stay."""
        for batch in batches:
            marks = batch.column(batch.schema.get_field_index("drop"))
            for part, data, offsets in passes([batch.append_column("row", pa.array(np.arange(batch.num_rows)))]):
                w = T.words(data, offsets)
                raw = data.tobytes()
                removed, kept = [], []
                for i, row in enumerate(part.column("row").to_pylist()):
                    n, first = int(w.counts[i]), int(w.first[i])
                    own = marks.slice(row, 1)
                    gone = np.zeros(n, bool)
                    if not own.null_count and n:
                        own = own.flatten()
                        lo, size = (own.field(k).to_numpy().astype(np.int64) for k in range(2))
                        if len(lo) and lo[0] < 0:  # a twin
                            gone[:] = n >= length
                        else:
                            gone = T.cover(lo, lo + size, n)
                    stay = np.flatnonzero(~gone) + first
                    removed.append(n - len(stay))
                    if not len(stay):
                        kept.append(b"")
                        continue
                    s, e = w.starts[stay], w.ends[stay]
                    size = e - s + 1
                    out = np.full(size.sum(), 32, np.uint8)
                    to = np.cumsum(size)
                    from_ = np.repeat(s - (to - size), size) + np.arange(to[-1])
                    inner = np.ones(len(out), bool)
                    inner[to - 1] = False
                    out[inner] = np.frombuffer(raw, np.uint8)[from_[inner]]
                    kept.append(out[:-1].tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(w.counts), pa.array(np.asarray(removed, np.int64)), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    kept = texts.select("doc_id", "text", "t1", "t2").join(drop, ["t1", "t2"], "left").select("doc_id", "text", "drop").mapInArrow(frugal(cut), "doc_id long, n_words long, n_removed long, kept_text string")
    numbered = rows.select("text", "spot").mapInArrow(frugal(name), f"t1 long, t2 long, {SPOT}, n long").join(rows.select("doc_id", "spot"), "spot")
    told = numbered.join(drop.select("t1", "t2", F.inline("drop")), ["t1", "t2"])
    told = told.select("doc_id", F.greatest("lo", F.lit(0)).alias("start"), F.when(F.col("lo") < 0, F.col("n")).otherwise(F.col("size")).cast("int").alias("size"))
    return kept, told.where(F.col("size") >= length)


def _pieces(part, i: np.ndarray, **columns) -> pa.RecordBatch:
    """Rows of PIECES, of the texts in rows i; columns that aren't given are null."""
    columns |= {c: part.column(part.schema.get_field_index(c)).take(pa.array(i)) for c in ("t1", "t2")}
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split(" ") for f in PIECES.split(", ")]
    made = [columns.get(f, pa.nulls(len(i), kinds[k])) for f, k in fields]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, kinds[k]) for x, (_, k) in zip(made, fields, strict=True)], [f for f, _ in fields])


def digest(kept: DataFrame) -> DataFrame:
    """op4's columns."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
