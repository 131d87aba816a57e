"""Spelling variants against plain Python: counts with lost letters, near words, forms and roots."""

import collections
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("finlattice.llm.queries")
from finlattice.llm import spelling  # noqa: E402

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=5, often=3, factor=2):
    count = collections.Counter()
    for i, t in rows:
        for x in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            x = x.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{x}".encode())
            if h % 97 == 0:
                x = x[: h % len(x)] + x[h % len(x) + 1 :]
            count[x] += 1
    n = {w: k for w, k in count.items() if len(w) >= least and k >= often}
    near = {w: {x for x in n if one_edit(w, x)} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(df):
    return sorted(tuple(r) for r in spelling.grouped(df).collect())


def texts():
    rng = np.random.default_rng(8)
    stems = ["".join(rng.choice(list("abé"), int(n))) for n in rng.integers(4, 12, 160)]
    weights = 1 / np.arange(1, len(stems) + 1)
    return [" ".join(rng.choice(stems, 300, p=weights / weights.sum())) for _ in range(30)]


def test_vocabulary_of_few_letters(spark):
    rows = [*enumerate(texts()), (3, texts()[3]), (None, texts()[0]), (50, None), (51, ""), (52, "ÀBCDÉ×÷ zß12ab_cd"), (53, ("w" * 700 + " ") * 3 + ("w" * 701 + " ") * 8)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, word string")
    assert grouped(df) == brute(rows)
    assert spelling.grouped(df.limit(0)).count() == 0
    assert grouped(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")) == []


def test_ways_of_many_forms(spark):
    words = ["aaaaa" + "b" * k for k in range(9)]
    rows = [(-1, " ".join(w for k, w in enumerate(words) for _ in range(3 << k)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert max(sum(1 for r in want if r[2] == w[0]) for w in want) > 5
    assert grouped(df) == want


def test_crc_of_joined_bytes():
    rng = np.random.default_rng(2)
    heads = [f"{i}:".encode() for i in rng.integers(0, 1 << 40, 50)]
    tails = [rng.bytes(int(n)) for n in rng.integers(0, 400, 50)]
    crc = lambda xs: np.asarray([zlib.crc32(x) for x in xs], np.uint32)
    got = spelling.joined_crc(crc(heads), crc(tails), np.asarray([len(t) for t in tails]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(heads, tails, strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text(st.sampled_from("abc"), min_size=5, max_size=7), min_size=2, max_size=60))
def test_active_nodes(words):
    """Within one block per length, with nothing shared ahead."""
    for size in {len(w) for w in words}:
        short, long = (sorted(w for w in words if len(w) == k) for k in (size, size + 1))
        m = lambda ws, k: np.frombuffer("".join(ws).encode(), np.uint8).reshape(-1, k)
        a, b = spelling.Trie(np.zeros(len(short), np.int64), m(short, size)), spelling.Trie(np.zeros(len(long), np.int64), m(long, size + 1))
        p, q = spelling.replaced(a, size)
        assert sorted((short[i], short[j]) for i, j in zip(p, q, strict=True)) == [(x, y) for x in short for y in short if x < y and one_edit(x, y)]
        r, s = spelling.inserted(a, b, size)
        assert sorted((short[i], long[j]) for i, j in zip(r, s, strict=True)) == [(x, y) for x in short for y in long if one_edit(x, y)]
