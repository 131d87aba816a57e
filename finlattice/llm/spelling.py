"""Spelling variants: words one edit apart, by a self-join of the vocabulary's trie with active-node sets."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T
from .work import Scratch, frugal, slices, text_of, utf8

#: Bytes of text whose words are counted at once, and words of the trie that one step takes (a block is never cut).
COUNT_PASS, TRIE_ROWS = 8 << 20, 1 << 17
#: Every NOISE-th number of a document and run, on average, loses a letter.
NOISE = 97
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
#: The lead byte in UTF-8 of all letters from U+00C0 to U+00FF.
_LEAD = 0xC3
_shifts: dict[int, np.ndarray] = {}


def _shift(size: int) -> np.ndarray:
    """Table (4, 256) of what `size` more zero bytes make of each byte of a crc32: the crc is linear in its bits."""
    if size not in _shifts:
        zeros = bytes(size)
        none = zlib.crc32(zeros)
        bits = np.asarray([zlib.crc32(zeros, 1 << b) ^ none for b in range(32)], np.uint32).reshape(4, 8)
        out = np.zeros((4, 256), np.uint32)
        for b in range(8):
            out[:, 1 << b : 2 << b] = out[:, : 1 << b] ^ bits[:, b : b + 1]
        _shifts[size] = out
    return _shifts[size]


def joined_crc(heads: np.ndarray, tails: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of each head followed by its tail, from the crc32 of both and the tail's size in bytes."""
    kinds, at = np.unique(sizes, return_inverse=True)
    tables = np.stack([_shift(int(s)) for s in kinds])
    out = tails.astype(np.uint32)
    for k in range(4):
        out = out ^ tables[at, k, (heads >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def runs(ids: list, data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[list[str], list[int]]:
    """Words of at least `least` code points of some texts, after the loss of letters, and how often each occurs."""
    data = T.LOWER[data]
    lead = data == _LEAD
    solid = _LETTER[data] | lead
    solid[1:] |= lead[:-1]
    w = T.words(data, offsets, solid)
    if not len(w.starts):
        return [], []
    size = w.ends - w.starts
    edge = np.append(0, np.cumsum(size))
    whole = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(edge), pa.py_buffer(data[solid])]).dictionary_encode()
    code, listed = whole.indices.to_numpy(), whole.dictionary
    words = listed.to_pylist()
    points = pc.utf8_length(listed).to_numpy()
    crc = np.asarray([zlib.crc32(x.encode()) for x in words], np.uint32)
    heads = np.asarray([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    h = joined_crc(heads[w.doc], crc[code], size)
    hit = h % np.uint32(NOISE) == 0
    n = np.bincount(code[~hit], minlength=len(words))
    keep = np.flatnonzero((n > 0) & (points >= least))
    out, counts = [words[i] for i in keep.tolist()], n[keep].tolist()
    odd, times = np.unique(h[hit].astype(np.uint64) << np.uint64(32) | code[hit].astype(np.uint64), return_counts=True)
    for x, k in zip(odd.tolist(), times.tolist()):
        s = words[x & 0xFFFFFFFF]
        i = (x >> 32) % len(s)
        s = s[:i] + s[i + 1 :]
        if len(s) >= least:
            out.append(s)
            counts.append(k)
    return out, counts


def vocabulary(docs: DataFrame, least: int = 5, often: int = 3) -> DataFrame:
    """word, n: words of `least` code points that occur `often` times in all texts; each pass adds its own up first."""

    def count(batches):
        for b in batches:
            data, offsets = utf8(b.column(1))
            ids = b.column(0).to_pylist()
            for lo, hi in slices(offsets, COUNT_PASS):
                words, n = runs(ids[lo:hi], data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], least)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    rows = docs.select(docs["doc_id"].cast("string").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(frugal(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def blocks(vocab: DataFrame) -> DataFrame:
    """Each word under the prefixes by which the trie is dealt: mirrored, size, key, longer, spelled, word, n.

    A block holds words of `size` and, as `longer`, of size + 1 letters below one prefix of half the size. Two words one
    edit apart share size - 1 letters at least at both ends together, so they meet below a prefix, or below a prefix
    of the words read backwards (mirrored). Blocks get smaller as the vocabulary's words get longer.
    """
    size = F.length("word")
    deal = lambda mirrored, longer: F.struct(F.lit(mirrored).alias("mirrored"), (size - longer).alias("size"), F.lit(bool(longer)).alias("longer"))
    d = vocab.select("word", "n", F.inline(F.array(*(deal(m, k) for m in (False, True) for k in (0, 1)))))
    depth = F.when(F.col("mirrored"), F.floor(F.col("size") / 2)).otherwise(F.ceil(F.col("size") / 2)).cast("int")
    spelled = F.when(F.col("mirrored"), F.reverse("word")).otherwise(F.col("word"))
    d = d.withColumn("spelled", spelled).withColumn("key", F.substring(F.col("spelled"), F.lit(1), depth))
    return d.select("mirrored", "size", "key", "longer", "spelled", "word", "n")


class Trie:
    """Levels of the trie of sorted words of one length below their blocks' prefixes; level 0 are the blocks."""

    def __init__(self, block: np.ndarray, letters: np.ndarray):
        new = np.append(True, block[1:] != block[:-1]) if len(block) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.roots = block[first]
        node = np.cumsum(new) - 1
        self.keys: list[np.ndarray] = []  # per level: parent * 256 + letter of each node, ascending
        self.begin: list[np.ndarray] = []  # per level: of each node, its first child on the next
        for t in range(letters.shape[1]):
            column = letters[:, t]
            grown = new.copy()
            grown[1:] |= column[1:] != column[:-1]
            first = np.flatnonzero(grown)
            self.keys.append(node[first].astype(np.int64) * 256 + column[first])
            self.begin.append(np.searchsorted(node[first], np.arange(node[-1] + 2 if len(node) else 1)))
            new, node = grown, np.cumsum(grown) - 1

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into nodes, child) for every child of every given node of a level."""
        lo, n = self.begin[level][nodes], np.diff(self.begin[level])[nodes]
        own = np.repeat(np.arange(len(nodes)), n)
        return own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + lo[own]

    def letter(self, level: int, nodes: np.ndarray) -> np.ndarray:
        return self.keys[level - 1][nodes] & 255

    def child(self, level: int, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The child of each node by its letter, or -1."""
        keys, want = self.keys[level], nodes * 256 + letters
        at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
        return np.where(keys[at] == want, at, -1) if len(keys) else np.full(len(want), -1)


def _follow(a: Trie, la: int, u: np.ndarray, b: Trie, lb: int, v: np.ndarray, ban: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Active pairs one letter further down: children of both by the same letter (unless that is banned)."""
    own, x = a.children(la, u)
    letter = a.letter(la + 1, x)
    y = b.child(lb, v[own], letter)
    ok = y >= 0
    if ban is not None:
        ok &= letter != ban[own]
    return x[ok], y[ok]


def replaced(t: Trie, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words (by place) that differ in one letter: siblings become active at distance one and go on in step."""
    u = v = np.zeros(0, np.int64)
    for level in range(depth):
        u, v = _follow(t, level, u, t, level, v)
        nodes = np.arange(len(t.keys[level]))
        place = nodes - t.begin[level][t.keys[level] >> 8]  # among its siblings
        own = np.repeat(nodes, place)
        before = own - 1 - (np.arange(len(own)) - np.repeat(np.cumsum(place) - place, place))
        u, v = np.append(u, before), np.append(v, own)
    return u, v


def inserted(a: Trie, b: Trie, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word of a, word of b) where b's has one letter more.

    The trunk holds nodes at distance 0. A further letter of b makes a node active at distance one; what follows must not
    begin with that letter, so that an insertion into a run of equal letters counts at the run's end only.
    """
    _, tu, tv = np.intersect1d(a.roots, b.roots, return_indices=True)
    u = v = np.zeros(0, np.int64)
    for level in range(depth + 1):
        own, y = b.children(level, tv)
        x, extra = tu[own], b.letter(level + 1, y)
        if level == depth:
            return np.append(u, x), np.append(v, y)
        u, v = _follow(a, level, u, b, level + 1, v)
        more = _follow(a, level, x, b, level + 1, y, extra)
        u, v = np.append(u, more[0]), np.append(v, more[1])
        tu, tv = _follow(a, level, tu, b, level, tv)
    raise AssertionError


def near_words(rows: pa.Table) -> pa.RecordBatch | None:
    """word, near, form_n, form: near words within whole blocks of one size and direction, added up per word."""
    size, mirrored = rows["size"][0].as_py(), rows["mirrored"][0].as_py()
    key = rows["key"].combine_chunks()
    block = np.append(0, np.cumsum(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False))).astype(np.int64)
    many = np.bincount(block)[block] > 1  # a word alone in its block meets nobody
    if not many.any():
        return None
    rows, block = rows.filter(pa.array(many)), block[many]
    longer = rows["longer"].to_numpy()
    spelled, n = rows["spelled"].to_pylist(), rows["n"].to_numpy()
    depth = size // 2 if mirrored else size - size // 2
    short, long = np.flatnonzero(~longer), np.flatnonzero(longer)
    letters = lambda at, k: np.frombuffer("".join([spelled[i] for i in at.tolist()]).encode("latin-1"), np.uint8).reshape(-1, k)
    x, y = letters(short, size), letters(long, size + 1)
    a, b = Trie(block[short], x[:, depth:]), Trie(block[long], y[:, depth:])
    p, q = replaced(a, size - depth)
    r, s = inserted(a, b, size - depth)
    if mirrored:  # those that share the other half's prefix are found there
        other = size - depth
        ends = lambda m, at: m[at][:, m.shape[1] - other :]
        fresh = (ends(x, p) != ends(x, q)).any(axis=1)
        p, q = p[fresh], q[fresh]
        fresh = (ends(x, r) != ends(y, s)).any(axis=1)
        r, s = r[fresh], s[fresh]
    left, right = np.append(short[p], short[r]), np.append(short[q], long[s])
    own, other = np.append(left, right), np.append(right, left)
    if not len(own):
        return None
    words = rows["word"].combine_chunks()
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    by = np.lexsort((rank[other], -n[other], own))
    own, other = own[by], other[by]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    best = other[first]
    return pa.RecordBatch.from_arrays([words.take(pa.array(own[first])), pa.array(np.diff(np.append(first, len(own)))), pa.array(n[best]), words.take(pa.array(best))], ["word", "near", "form_n", "form"])


def _whole_blocks(batches) -> Iterator[pa.Table]:
    """Sorted rows in tables of whole blocks of one size and direction, of some TRIE_ROWS rows."""

    def cut(t: pa.Table) -> np.ndarray:
        """Places where a block begins, but the first."""
        return np.flatnonzero(np.logical_or.reduce([pc.not_equal(t[c].combine_chunks()[1:], t[c].combine_chunks()[:-1]).to_numpy(zero_copy_only=False) for c in ("mirrored", "size", "key")])) + 1

    def alike(t: pa.Table) -> Iterator[pa.Table]:
        kind = t["size"].to_numpy() * 2 + t["mirrored"].to_numpy()
        edge = [0, *(np.flatnonzero(kind[1:] != kind[:-1]) + 1).tolist(), len(kind)]
        for lo, hi in zip(edge, edge[1:]):
            yield t.slice(lo, hi - lo)

    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= TRIE_ROWS:
            t = pa.Table.from_batches(held).combine_chunks()
            at = cut(t)
            if len(at):
                yield from alike(t.slice(0, int(at[-1])))
                t = t.slice(int(at[-1]))
            held = t.to_batches()
    if held:
        yield from alike(pa.Table.from_batches(held).combine_chunks())


def grouped(docs: DataFrame, least: int = 5, often: int = 3, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n: the words of all texts and the more common spelling of each, if it has one.

    Runs of letters (A-Z lower-cased, U+00C0 to U+00FF as they are) are words; a run whose crc32 with its doc_id is a
    multiple of NOISE first loses a letter. Words of `least` code points and `often` occurrences (n) form a trie, dealt by
    prefixes over tasks (see blocks()). Down each block's trie go active pairs of nodes at distance 0 or 1, level by
    level and for all blocks of a batch at once; pairs of ends at distance 1 are near words. `form` is the near word of
    largest n (ties: smallest in code-point order), if that is `factor` times the word's n at least, and `root` the last
    form on the way from a word. n grows along forms, so the way ends; its length halves with each join.

    Null doc_ids count as '', null or empty texts hold no words, repeated rows count each, texts of any length are read
    whole, an empty table gives no rows; other columns are not read, whatever their names. A very common word is one row
    per pass of text before the shuffle. A block is one prefix's words of two lengths, which one task takes whole.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "spelling")
    vocab = scratch.keep(vocabulary(docs, least, often))

    def join(batches):
        for t in _whole_blocks(batches):
            out = near_words(t)
            if out is not None:
                yield out

    dealt = blocks(vocab).where(F.col("size") >= least).repartition("mirrored", "size", "key").sortWithinPartitions("mirrored", "size", "key", "longer", "spelled")
    near = dealt.mapInArrow(frugal(join), "word string, near long, form_n long, form string")
    both = vocab.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("form_n"), F.lit(None).cast("string").alias("form"))
    both = both.unionByName(near.select("word", F.lit(None).cast("long").alias("n"), "near", "form_n", "form"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("n"), "form"))).alias("best")
    g = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best)
    fit = -F.col("best.n") >= factor * F.col("n")
    found = scratch.keep(g.select("word", "n", "n_near", F.when(fit, F.col("best.form")).alias("form"), F.when(fit, -F.col("best.n")).alias("form_n")))
    scratch.drop(vocab)
    links = scratch.keep(found.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while links.where("moved").limit(1).count():
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = scratch.keep(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(links)
        links = further
    return found.join(links.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
