"""Two tokenizers on the same texts: groups of tokens with common ends, and how often ids of both meet in the corpus."""

from __future__ import annotations

import hashlib
import itertools
import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import byte_letters
from .work import Scratch, frugal, slices, text_of, utf8

#: Bytes of text that make a chunk (a longer text is a chunk of its own).
CHUNK = 4 << 20
#: Units that one splitter may read: longer ones, and those with other letters, go to the tokenizer that the file belongs to.
_PLAIN, _LONG = "^[\n\t\r\x20-\x7eÀ-ÖØ-öø-įı-ɏ]*$", 1000
#: Groups with more links than this have their equal ids merged before they are multiplied out.
_MANY = 4096
#: Tokens, or pairs of texts, that one step works on.
STEP = 1 << 18
#: Units that are tokenised at once.
UNITS = 1 << 14
#: A pair is id A * SIDE + id B.
SIDE = 1 << 16
#: How words are cut before the merges of the byte-level vocabulary.
_CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of some strings and where each begins."""
    return np.frombuffer(b"".join(pieces), np.uint8), np.append(0, np.cumsum([len(p) for p in pieces]))


def _gather(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings of `ids` one after the other, and where each ends."""
    data, begin = table
    size = begin[ids + 1] - begin[ids]
    ends = np.cumsum(size)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for lo in range(0, len(ids), STEP):  # a part at a time, as places take more room than bytes
        hi = min(lo + STEP, len(ids))
        first, n = ends[lo] - size[lo], size[lo:hi]
        at = np.arange(ends[hi - 1] - first) - np.repeat(ends[lo:hi] - first - n - begin[ids[lo:hi]], n)
        out[first : ends[hi - 1]] = data[at]
    return out, ends


class Pair:
    """Both tokenizers. One per Python worker."""

    _made: dict[tuple[str, str], Pair] = {}

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        with open(byte_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        spelled = {i: bytes(byte_of[c] for c in x) for x, i in model["vocab"].items() if all(c in byte_of for c in x)}
        self.a_bytes = _table([spelled.get(i, b"") for i in range(self.a.get_vocab_size())])
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        # ids in order of merges are ranks, by which the faster splitter merges too
        self.fast = tiktoken.Encoding("ranks", pat_str=_CUT, mergeable_ranks={v: k for k, v in spelled.items()}, special_tokens={}) if merged == sorted(merged) else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        odd = [self.b.is_control(i) or self.b.is_unknown(i) for i in range(len(pieces))]
        raw = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
        self.b_bytes = _table([b"" if o else raw(p) for p, o in zip(pieces, odd)])
        #: No piece goes on after a space within it, so texts may be cut before one; else they aren't cut.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.digits = _table([str(i).encode() for i in range(max(self.a.get_vocab_size(), len(pieces)))])

    @classmethod
    def of(cls, byte_path: str, piece_path: str) -> Pair:
        if (byte_path, piece_path) not in cls._made:
            cls._made[byte_path, piece_path] = cls(byte_path, piece_path)
        return cls._made[byte_path, piece_path]

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct units of the texts (each behind a space), the unit at each place and each text's first place.

        A unit begins at a space behind a letter or sign, where neither tokenizer joins anything. White space behind
        white space, and a space at the end, stay in one unit.
        """
        data, offsets = np.insert(data, offsets[:-1], 32), offsets + np.arange(len(offsets))
        back, back2 = np.append(np.uint8(32), data)[:-1], np.append(np.zeros(2, np.uint8), data)[:-2]
        firm = (back > 32) & (back < 127) | (back > 127) & (back < 0xC0) & (back2 >= 0xC3) & (back2 < 0xE0)
        begins = (data == 32) & firm & self.cuts
        begins[offsets[1:] - 1] = False
        begins[offsets[:-1]] = True
        starts = np.flatnonzero(begins)
        edge = np.append(starts, len(data))
        whole = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(edge), pa.py_buffer(data)]).dictionary_encode()
        return whole.dictionary, whole.indices.to_numpy(), np.searchsorted(starts, offsets)

    def ids(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids and how many each unit has, of either tokenizer."""
        parts = [self._some(units.slice(lo, UNITS)) for lo in range(0, len(units), UNITS)]
        return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4))

    def _some(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        texts = units.to_pylist()
        plain = pc.and_(pc.match_substring_regex(units, _PLAIN), pc.less(pc.binary_length(units), _LONG)).to_numpy(zero_copy_only=False)
        a: list = [self.fast.encode_ordinary(t) if p else None for t, p in zip(texts, plain.tolist())] if self.fast else [None] * len(texts)
        rest = [i for i, x in enumerate(a) if x is None]
        for i, e in zip(rest, self.a.encode_batch([texts[i] for i in rest], add_special_tokens=False)):
            a[i] = e.ids
        b = self.b.encode([t[1:] for t in texts], num_threads=1)  # which puts the space back
        space = self.b.piece_to_id("▁")
        b = [x if t != " " else [space] for x, t in zip(b, texts)]
        flat = lambda x: (np.fromiter(itertools.chain.from_iterable(x), np.int64), np.fromiter(map(len, x), np.int64, len(x)))
        return *flat(a), *flat(b)


class Chunk:
    """The distinct units of a chunk: their groups and links. Units that either tokenizer doesn't give back are bad."""

    def __init__(self, pair: Pair, units: pa.Array):
        n = len(units)
        a, na, b, nb = pair.ids(units)
        raw, offsets = utf8(units)
        size = np.diff(offsets)
        self.bad = np.zeros(n, bool)
        for ids, count, table in ((a, na, pair.a_bytes), (b, nb, pair.b_bytes)):
            unit = np.repeat(np.arange(n), count)
            length = table[1][ids + 1] - table[1][ids]
            self.bad[unit[length == 0]] = True
            self.bad |= np.bincount(unit, length, n).astype(np.int64) != size
        for ids, count, table in ((a, na, pair.a_bytes), (b, nb, pair.b_bytes)):
            ok = ~self.bad
            said, _ = _gather(table, ids[np.repeat(ok, count)])
            own = np.repeat(np.flatnonzero(ok), size[ok])
            self.bad[own[said != raw[np.repeat(ok, size)]]] = True
        ok = ~self.bad
        a, b = a[np.repeat(ok, na)], b[np.repeat(ok, nb)]
        self.na, self.nb = np.where(ok, na, 0), np.where(ok, nb, 0)
        _, ends_a = _gather(pair.a_bytes, a)
        _, ends_b = _gather(pair.b_bytes, b)
        # the merge of both sorted lists of ends: a group ends where both have one
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        ga, gb = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        ca, cb = np.bincount(ga, minlength=len(common)), np.bincount(gb, minlength=len(common))
        unit = np.repeat(np.arange(n), self.na)[np.cumsum(ca) - 1] if len(common) else np.zeros(0, np.int64)
        self.groups = np.bincount(unit, minlength=n)
        self.links = np.zeros(n, np.int64)
        np.add.at(self.links, unit, ca * cb)
        self._spell(pair, a, ga, ca, b, gb, cb, unit, n)
        self._link(a, ga, ca, b, gb, cb, unit, n)

    def _spell(self, pair, a, ga, ca, b, gb, cb, unit, n) -> None:
        """Each unit's groups as text, every group closed by a semicolon."""
        before_a, before_b = np.append(0, np.cumsum(ca)), np.append(0, np.cumsum(cb))
        at_a, at_b = np.arange(len(a)) + before_b[ga], np.arange(len(b)) + before_a[gb + 1]
        ids, sign = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), 44, np.uint8)
        ids[at_a], ids[at_b] = a, b
        if len(ids):
            sign[at_a[before_a[1:] - 1]] = 124
            sign[at_b[before_b[1:] - 1]] = 59
        digits, ends = _gather(pair.digits, ids)
        text = np.insert(digits, ends, sign).tobytes()
        ends = np.append(0, ends + np.arange(1, len(ids) + 1))
        last = np.append(0, np.cumsum(self.na + self.nb))
        edge = ends[last].tolist()
        self.text = [text[i:j] for i, j in zip(edge, edge[1:])]

    def _link(self, a, ga, ca, b, gb, cb, unit, n) -> None:
        """pairs: the distinct pairs; of each unit (from first[u]) the place of each of its pairs and how often it has it."""
        one = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
        many = ca * cb > _MANY
        if many.any():
            a, ga, ca, wa = _merged(a, ga, many, one[0], len(ca))
            b, gb, cb, wb = _merged(b, gb, many, one[1], len(cb))
        else:
            wa, wb = one
        times = cb[ga]
        left = np.repeat(np.arange(len(a)), times)
        begin = np.append(0, np.cumsum(cb))[ga]
        right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + begin[left]
        self.pairs, self.place = np.unique(a[left] * SIDE + b[right], return_inverse=True)
        self.times = wa[left] * wb[right]
        self.first = np.append(0, np.cumsum(np.bincount(unit[ga[left]], minlength=n)))

    def docs_of(self, doc: np.ndarray, code: np.ndarray) -> np.ndarray:
        """How many texts hold each pair; doc and code: text and unit at each place."""
        both = np.unique(doc << 32 | code)
        doc, code = both >> 32, both & 0xFFFFFFFF
        n = np.diff(self.first)[code]
        out, rows = np.zeros(len(self.pairs), np.int64), np.append(0, np.cumsum(n))
        begins = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc)) if len(doc) else np.zeros(1, np.int64)
        lo = 0
        while lo < len(begins) - 1:  # whole texts, some STEP rows at once
            hi = max(lo + 1, int(np.searchsorted(rows[begins], rows[begins[lo]] + STEP, side="right")) - 1)
            own = slice(begins[lo], begins[hi])
            k, c = n[own], code[own]
            at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k - self.first[c], k)
            held = np.unique(np.repeat(doc[own], k) << 32 | self.place[at])
            out += np.bincount(held & 0xFFFFFFFF, minlength=len(out))
            lo = hi
        return out


def _merged(ids, group, many, weight, n):
    """Ids of each group, equal ones of the groups in `many` as one of a higher weight."""
    big = many[group]
    key, times = np.unique(group[big] << 20 | ids[big], return_counts=True)
    ids, group, weight = np.append(ids[~big], key & 0xFFFFF), np.append(group[~big], key >> 20), np.append(weight[~big], times)
    by = np.argsort(group, kind="stable")
    return ids[by], group[by], np.bincount(group, minlength=n), weight[by]


ALIGNED = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units array<int>, pairs array<long>, docs array<long>, first array<int>, place array<int>, times array<long>"


def aligned(pair: Pair, chunk: int, ids: list, data: np.ndarray, offsets: np.ndarray) -> pd.DataFrame:
    """A row per text, with its units, and a last row with the links of the units."""
    size = np.diff(offsets)
    full = np.flatnonzero(size > 0)
    dictionary, code, first = pair.units(data, np.append(0, np.cumsum(size[full])))
    c = Chunk(pair, dictionary)
    bad = np.append(0, np.cumsum(c.bad[code]))
    good = bad[first[1:]] == bad[first[:-1]]
    sums = [np.append(0, np.cumsum(x[code])) for x in (c.na, c.nb, c.groups, c.links)]
    doc = np.repeat(np.arange(len(full)), np.diff(first))
    use = good[doc]
    out = {k: np.zeros(len(size) + 1, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
    for k, s in zip(out, sums):
        out[k][full[good]] = (s[first[1:]] - s[first[:-1]])[good]
    sha, units = [""] * len(size) + [None], [None] * (len(size) + 1)
    edge = first.tolist()
    for i in np.flatnonzero(good).tolist():
        own = code[edge[i] : edge[i + 1]].tolist()
        sha[full[i]] = hashlib.sha256(b"".join([c.text[u] for u in own])[:-1]).hexdigest()
        units[full[i]] = code[edge[i] : edge[i + 1]]
    none = [None] * len(size)
    docs = c.docs_of(doc[use], code[use].astype(np.int64))
    held = docs > 0  # pairs of texts with bad units only are none
    place = np.where(held, np.cumsum(held) - 1, -1)[c.place]
    keep = place >= 0
    begin = np.append(0, np.cumsum(keep))[c.first]
    arrays = {"pairs": c.pairs[held], "docs": docs[held], "first": begin.astype(np.int32), "place": place[keep].astype(np.int32), "times": c.times[keep]}
    frame = {"chunk": np.full(len(size) + 1, chunk), "doc_id": pd.array([*ids, None], "Int64"), **out, "groups_sha256": sha, "units": units}
    return pd.DataFrame(frame | {k: [*none, v] for k, v in arrays.items()})


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A is a byte-level BPE (byte_path) on a space and the text, B a piece BPE (piece_path) on the text. Byte offsets where
    tokens of both end cut them into groups; all A-B pairs of occurrences in a group are links. A pair's count is the number
    of rows that have such a link; n_best counts links whose pair has its A id's highest count, count_sum adds up counts.
    Texts are cut into units where neither tokenizer joins anything, and each distinct unit of a chunk of texts is
    tokenised and merged once. A chunk hands on each of its pairs once with the number of its texts; Spark adds them up,
    finds each A id's maximum and joins both back to the chunks. So a pair that all texts hold is a row per chunk.

    Null or empty texts, and texts that a tokenizer doesn't give back byte for byte, have no tokens: zeros and ''. Repeated
    rows count each; a null doc_id is kept; an empty table gives no rows; other columns are not read, whatever their names. A
    long text is a chunk of its own. A group of many tokens counts by distinct ids, with their numbers.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")

    def run(frames):
        pair, k = Pair.of(byte_path, piece_path), 0
        for f in frames:
            data, offsets = utf8(pa.array(f["text"], pa.large_string()))
            ids = f["doc_id"].tolist()
            for lo, hi in slices(offsets, CHUNK):
                yield aligned(pair, TaskContext.get().partitionId() << 32 | k, ids[lo:hi], data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                k += 1

    rows = docs.select(docs["doc_id"].cast("long").cast("string").alias("doc_id"), text_of(docs).alias("text"))
    table = scratch.keep(rows.mapInPandas(frugal(run), ALIGNED))
    held = table.where("pairs is not null").select("chunk", F.inline(F.arrays_zip("pairs", "docs")))
    counts = held.groupBy("pairs").agg(F.sum("docs").alias("n"))
    counts = scratch.keep(counts.withColumn("a", F.floor(F.col("pairs") / SIDE)))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))  # a row per id of vocabulary A
    counts = counts.join(F.broadcast(top), "a").select("pairs", "n", (F.col("n") == F.col("top")).alias("best"))
    back = held.select("chunk", "pairs").join(counts, "pairs").select(F.col("chunk").alias("of"), "pairs", "n", "best")

    def finish(own: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        is_doc = own["first"].isna()
        out = own.loc[is_doc, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].copy()
        unit = own.loc[~is_doc].iloc[0]
        said = said.sort_values("pairs")
        first, place, times = (np.asarray(unit[c], np.int64) for c in ("first", "place", "times"))
        for name, column in (("n_best", "best"), ("count_sum", "n")):
            run_up = np.append(0, np.cumsum(said[column].to_numpy(np.int64)[place] * times))
            per = run_up[first[1:]] - run_up[first[:-1]]
            out[name] = [0 if u is None else int(per[u].sum()) for u in own.loc[is_doc, "units"]]
        return out

    whole = table.select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "units", "first", "place", "times")
    done = whole.groupBy("chunk").cogroup(back.groupBy("of")).applyInPandas(finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
