"""Quality rules: a suffix array over the words of each text limits how much it repeats itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textcore as T
from .work import frugal, passes, ship, text_of

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"
#: Words of the longest repeat that a text may hold.
MAX_LONGEST = 200
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def suffix_array(tokens: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """Suffix array of all texts at once by prefix doubling; a suffix ends with its text.

    tokens: equal numbers are equal words. ends: per word, where its text ends. Returns the array and the doubling
    steps it took: no two suffixes share 2 ** steps words. Only suffixes not yet told apart are sorted again, so a
    text without repeats costs two sorts; memory is a few numbers a word, whatever the repeats.
    """
    n = len(tokens)
    key = tokens ^ T.mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    start = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = start[np.cumsum(new) - 1]
    size = np.diff(np.append(start, n))
    active = order[np.repeat(size > 1, size)]
    steps = 0
    while len(active):
        ahead = active + (1 << steps)
        follow = np.where(ahead < ends[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
        old = rank[active]
        by = np.lexsort((follow, old))
        active, old, follow = active[by], old[by], follow[by]
        group = np.ones(len(active), bool)
        group[1:] = old[1:] != old[:-1]
        fine = group.copy()
        fine[1:] |= follow[1:] != follow[:-1]
        at = np.arange(len(active))
        base = at[group][np.cumsum(group) - 1]
        begin = at[fine]
        rank[active] = old + (begin[np.cumsum(fine) - 1] - base)
        size = np.diff(np.append(begin, len(active)))
        active = active[np.repeat(size > 1, size)]
        steps += 1
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    return array, steps


def common_prefixes(array: np.ndarray, steps: int, tokens: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix with the next one in the array, in words, by hashes of ranges, the longest range first."""
    a, b = array[:-1], array[1:]
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero((tokens[a] == tokens[b]) & (doc[a] == doc[b]))
    a, b = a[live], b[live]
    got, ea, eb = np.zeros(len(a), np.int64), ends[a], ends[b]
    roll = T.word_roller(tokens)
    for s in range(steps, -1, -1):
        x, y = a + got, b + got
        room = np.flatnonzero((x + (1 << s) <= ea) & (y + (1 << s) <= eb))
        x, y = x[room], y[room]
        got[room] += (roll.ranges(x, x + (1 << s)) == roll.ranges(y, y + (1 << s))) * (1 << s)
    out[live] = got
    return out


def repeats(tokens: np.ndarray, first: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: words in repeated substrings of `least` words or more, and the longest such substring."""
    docs = len(first) - 1
    if not len(tokens):
        return np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    ends = np.repeat(first[1:], np.diff(first))
    array, steps = suffix_array(tokens, doc, ends)
    lcp = common_prefixes(array, steps, tokens, doc, ends)
    longest = np.zeros(len(tokens), np.int64)
    # a suffix shares most with a neighbour: the ends of the LCP intervals that hold it
    longest[array[:-1]] = lcp
    longest[array[1:]] = np.maximum(longest[array[1:]], lcp)
    longest[longest < least] = 0
    at = np.flatnonzero(longest)
    covered = T.cover(at, at + longest[at], len(tokens))
    n_covered = np.bincount(doc, weights=covered, minlength=docs).astype(np.int64)
    most = np.zeros(docs, np.int64)
    np.maximum.at(most, doc[at], longest[at])
    return n_covered, most


def measure(data: np.ndarray, offsets: np.ndarray, least: int, max_percent: int, max_longest: int) -> dict[str, np.ndarray]:
    w = T.words(data, offsets)
    docs = len(offsets) - 1
    roll = w.roller()
    hashes = roll.ranges(w.starts, w.ends)
    # lines
    newline = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], newline + 1]))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    ok = np.diff(offsets) > 0
    starts, doc = starts[doc < docs], doc[doc < docs]
    starts, doc = starts[ok[doc]], doc[ok[doc]]
    stops = np.minimum(np.append(starts[1:], offsets[-1]), offsets[doc + 1])
    if len(starts):
        ends_nl = (stops > starts) & (data[np.maximum(stops - 1, 0)] == 10)
        stops = stops - ends_nl
        solid = np.zeros(len(data) + 1, np.int64)
        np.cumsum(w.solid, out=solid[1:])
        full = solid[stops] > solid[starts]
        starts, stops, doc = starts[full], stops[full], doc[full]
    key = roll.ranges(starts, stops) ^ T.mix(doc.astype(np.uint64) + np.uint64(7))
    by = np.argsort(key, kind="stable")
    again = key[by][1:] == key[by][:-1]
    dup_lines = np.bincount(doc[by][1:][again], minlength=docs) if len(by) else np.zeros(docs, np.int64)
    # three-word windows
    at, h = T.windows(hashes, w.first, 3)
    h = h ^ T.mix(w.doc[at].astype(np.uint64) + np.uint64(7))
    by = np.argsort(h, kind="stable")
    again = np.zeros(len(by) + 1, bool)
    again[1:-1] = h[by][1:] == h[by][:-1]
    hit = at[by[again[:-1] | again[1:]]] if len(by) else at
    repeat_words = w.sums(T.cover(hit, hit + 3, len(hashes)))
    n_words = w.counts
    covered, longest = repeats(hashes, w.first, w.doc, least)
    failed = (n_words < 50) | (100 * repeat_words > 50 * n_words)
    bad = (100 * covered > max_percent * n_words) | (longest > max_longest)
    return {
        "n_words": n_words, "word_chars": w.byte_sums(w.solid & ((data & 0xC0) != 0x80)), "n_symbols": w.byte_sums(_SYMBOL[data]),
        "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "base_failed": failed, "kept": ~failed & ~bad,
        "covered_words": covered, "longest_repeat": longest,
    }


def quality_rules(docs: DataFrame, least_words: int = 6, max_covered_percent: int = 30, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per document with its base measures and the suffix-array verdict.

    A substring of `least_words` words or more that a text holds twice (overlaps included) is a repeat; the
    spans of all repeats are united. A text fails if they cover more than `max_covered_percent` of its words or
    if one repeat is longer than `max_longest` words. Null text: none (0 words, base_failed). Repeated rows are
    judged one by one; a long text is judged whole, in memory that grows with its words; an empty table gives no rows;
    other columns of the input are not read, whatever their names. No shuffle.
    """

    ship(docs.sparkSession)

    def run(batches):
        for rows, data, offsets in passes(batches):
            got = measure(data, offsets, least_words, max_covered_percent, max_longest)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(v) for v in got.values())], ["doc_id", *got])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(frugal(run), SCHEMA)
