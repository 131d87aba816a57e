"""Ids of a public byte-level BPE vocabulary with word ends, merged for all distinct words of a batch at once."""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from . import textcore as T

#: Texts of these characters only (no apostrophe) split by byte classes; any other goes to the tokenizer whole.
_PLAIN = re.compile(r"[\n\t\r\x20-&(-\x7eÀ-ÖØ-öø-įı-ɏ]*")
_ODD = np.zeros(256, bool)
_ODD[:32] = _ODD[39] = _ODD[127] = True
_ODD[[9, 10, 13]] = False
#: How the vocabulary's own tokens begin; a text with one of them goes to the tokenizer whole.
_MARK = "<|"
#: Bytes of the longest word that is merged here; the tokenizer takes longer ones.
_LONGEST = 32
_CLASS = np.full(256, 1, np.uint8)  # letters, by the choice of texts also all bytes over 127
_CLASS[:128] = 3
_CLASS[[0, 9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123] = _CLASS[65:91] = 1
_CLASS[48:58] = 2
_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Ids:
    """ids(texts): all ids, and how many each text has. One per Python worker."""

    _made: dict[str, Ids] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.asarray([vocab[x] for x in letters], np.int32)
        self.last = np.asarray([vocab[x + end] for x in letters], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.asarray([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        made = np.asarray([vocab[a + b] for a, b in merges], np.int64)
        by = np.argsort(key)
        self.keys, self.rank, self.made = key[by], by.astype(np.int32), made.astype(np.int32)
        self.before = (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(1, np.int64))
        base = np.arange(max(self.inner.max(), self.last.max()) + 1)
        self.pairs = self._ranks(base[:, None], base[None, :])  # of single bytes

    @classmethod
    def of(cls, path: str) -> Ids:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or none."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def merge(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge each row's pair of lowest rank, leftmost first, until none is left; rows are padded with 0."""
        n, width = symbols.shape
        cols = np.arange(width)
        ranks = np.full((n, width), _NONE, np.int32)
        if width > 1:
            ranks[:, :-1] = np.where(cols[:-1] < size[:, None] - 1, self.pairs[symbols[:, :-1], symbols[:, 1:]], _NONE)
        out, out_size = symbols.copy(), size.copy()
        row, sym, size = np.arange(n), symbols.copy(), size.copy()
        while len(row):
            best = ranks.argmin(axis=1)
            r = ranks[np.arange(len(row)), best]
            done = r == _NONE
            if done.any():
                out[row[done]], out_size[row[done]] = sym[done], size[done]
                go = ~done
                row, sym, size, ranks, best, r = row[go], sym[go], size[go], ranks[go], best[go], r[go]
                if not len(row):
                    break
            at = np.arange(len(row))
            take = np.minimum(cols + (cols > best[:, None]), width - 1)
            sym, ranks = np.take_along_axis(sym, take, 1), np.take_along_axis(ranks, take, 1)
            ranks[:, -1] = _NONE
            new = self.made[r]
            sym[at, best] = new
            size -= 1
            right = best + 1 < size
            ranks[at, best] = np.where(right, self._ranks(new, sym[at, np.minimum(best + 1, width - 1)]), _NONE)
            left = best > 0
            to = np.maximum(best - 1, 0)
            ranks[at[left], to[left]] = self._ranks(sym[at[left], to[left]], new[left])
        return out, out_size

    def _words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of distinct words, and how many each has."""
        size = ends - starts
        counts = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in ((1, 4), (5, 8), (9, 12), (13, 20), (21, _LONGEST)):
            own = np.flatnonzero((size >= lo) & (size <= hi))
            for k in range(0, len(own), 60_000):
                part = own[k : k + 60_000]
                at = starts[part][:, None] + np.arange(hi)
                inside = np.arange(hi) < size[part][:, None]
                raw = data[np.minimum(at, len(data) - 1)]
                sym = np.where(inside, self.inner[raw], 0)
                sym[np.arange(len(part)), size[part] - 1] = self.last[data[ends[part] - 1]]
                got, n = self.merge(sym, size[part].astype(np.int32))
                counts[part] = n
                parts.append((part, got, n))
        long = np.flatnonzero(size > _LONGEST)
        extra = {}
        for i in long.tolist():
            extra[i] = np.asarray(self.tokenizer.encode(data[starts[i] : ends[i]].tobytes().decode(), add_special_tokens=False).ids, np.int64)
            counts[i] = len(extra[i])
        to = np.append(0, np.cumsum(counts))
        flat = np.empty(to[-1], np.uint32)
        for part, got, n in parts:
            keep = np.arange(got.shape[1]) < n[:, None]
            flat[(to[part][:, None] + np.arange(got.shape[1]))[keep]] = got[keep]
        for i, v in extra.items():
            flat[to[i] : to[i + 1]] = v
        return flat, counts

    @staticmethod
    def _keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each word, a part of the bytes at a time."""
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            lo = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, lo + (1 << 20), side="right")))
            out[at:to] = T.Roller(T._TABLE[data[lo : ends[to - 1]]], T._BASE).ranges(starts[at:to] - lo, ends[at:to] - lo)
            at = to
        return out

    def _known(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As _words, for words of sorted distinct keys; those of the batch before are remembered."""
        old, old_flat, old_first = self.before
        at = np.minimum(np.searchsorted(old, keys), max(len(old) - 1, 0))
        seen = old[at] == keys if len(old) else np.zeros(len(keys), bool)
        size = np.zeros(len(keys), np.int64)
        new = ~seen
        flat_new, size[new] = self._words(data, starts[new], ends[new])
        size[seen] = (old_first[1:] - old_first[:-1])[at[seen]]
        first = np.append(0, np.cumsum(size))
        flat = np.empty(first[-1], np.uint32)
        for own, source, begin in ((new, flat_new, None), (seen, old_flat, old_first[:-1][at[seen]] if len(old) else None)):
            n = size[own]
            if n.sum():
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                flat[np.repeat(first[:-1][own], n) + step] = source if begin is None else source[np.repeat(begin, n) + step]
        self.before = (keys, flat, first)
        return flat, size

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole, plain = {}, []
        for i, t in enumerate(texts):
            if _MARK in t or ("'" in t or "\0" in t if t.isascii() else not _PLAIN.fullmatch(t) or not unicodedata.is_normalized("NFC", t)):
                whole[i] = np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
                plain.append("")
            else:
                plain.append(t)
        data = np.frombuffer("\0".join(plain).lower().encode() + b"\0", np.uint8)
        offsets = np.append(0, np.flatnonzero(data == 0) + 1)
        odd = np.flatnonzero(_ODD[data] & (data != 0))
        for i in np.unique(np.searchsorted(offsets, odd, side="right") - 1).tolist():
            whole[i] = np.asarray(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        kind = _CLASS[data]
        edge = np.ones(len(data), bool)
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        cut = np.flatnonzero(edge)
        stop = np.append(cut[1:], len(data))
        real = kind[cut] != 0
        starts, ends = cut[real], stop[real]
        if len(starts):
            own, sample, inverse = np.unique(self._keys(data, starts, ends), return_index=True, return_inverse=True)
            flat, size = self._known(own, data, starts[sample], ends[sample])
            first = np.append(0, np.cumsum(size))[:-1]
            n = size[inverse]
            to = np.cumsum(n)
            out = flat[np.repeat(first[inverse] - (to - n), n) + np.arange(to[-1])]
            sums = np.append(0, to)[np.searchsorted(starts, offsets)]
        else:
            out, sums = np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        counts = np.diff(sums)
        if whole:
            parts = [whole[i] if i in whole else out[sums[i] : sums[i + 1]] for i in range(len(texts))]
            out, counts = np.concatenate(parts), np.asarray([len(p) for p in parts], np.int64)
        return out, counts
