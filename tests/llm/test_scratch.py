"""Scratch tables belong to the call that made them; long texts go through every operator whole."""

import collections
import hashlib
import threading
import zlib

import pytest

pytest.importorskip("finlattice.llm.queries")
from finlattice.llm import lm, packing, sharding, substring, work  # noqa: E402
from finlattice.llm.queries import vocabulary  # noqa: E402


def test_spent_tables_are_those_of_the_thread(spark):
    ready, go = threading.Event(), threading.Event()
    kept = {}

    def other():
        with work.collected() as spent:
            kept["df"] = work.Scratch(spark, "other").keep(spark.range(5))
            ready.set()
            go.wait(60)
            kept["n"] = kept["df"].count()
            spent()

    t = threading.Thread(target=other)
    t.start()
    ready.wait(60)
    with work.collected() as spent:
        mine = work.Scratch(spark, "mine").keep(spark.range(3))
        spent()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist|FileNotFound|FAILED_READ_FILE"):
        spark.read.parquet(mine._scratch_path).count()
    go.set()
    t.join()
    assert kept["n"] == 5


def test_the_setting_is_put_back(spark):
    before = spark.conf.get(work.CLEANUP, "false")
    threads = [threading.Thread(target=lambda: work.Scratch(spark, "s").keep(spark.range(100))) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert spark.conf.get(work.CLEANUP, "false") == before


@pytest.fixture(scope="module")
def long_docs(spark):
    """Texts of a million characters and more, one of a single word, beside short ones; a passage at the long one's end is shared."""
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"w{i % 5000}x{i % 7}" for i in range(150_000)) + " " + passage
    rows = [(1, long), (2, passage), (3, "z" * 1_200_000), (4, "a b c"), (5, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_sharding_of_long_texts(long_docs):
    rows, df = long_docs
    got = sharding.digest(sharding.shuffled(df, 3)).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)


def test_packing_of_long_texts(long_docs):
    from tokenizers import Tokenizer

    rows, df = long_docs
    tok = Tokenizer.from_file(vocabulary())
    want = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows}
    got = collections.Counter()
    for r in packing.pack(df, vocabulary()).collect():
        assert r.doc_tokens == want[r.doc_id]
        got[r.doc_id] += r.length
    assert dict(got) == want


def test_substring_of_long_texts(long_docs):
    rows, df = long_docs
    got = {r.doc_id: r for r in substring.digest(substring.deduplicated(df)).collect()}
    words = rows[0][1].split(" ")
    assert (got[1].n_words, got[2].n_removed) == (len(words), 60)
    seen = collections.Counter(tuple(words[i : i + 35]) for i in range(len(words) - 34)) + collections.Counter(tuple(words[-60:][i : i + 35]) for i in range(26))
    gone = [False] * len(words)
    for i in range(len(words) - 34):
        if seen[tuple(words[i : i + 35])] > 1:
            gone[i : i + 35] = [True] * 35
    left = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
    assert got[1].kept_sha256 == hashlib.sha256(left.encode()).hexdigest() and (got[3].n_words, got[3].n_removed) == (1, 0)


def test_scores_of_long_texts(long_docs):
    rows, df = long_docs
    got = {r.doc_id: r for r in lm.backoff_scores(df, 1).collect()}
    assert got[1].n_words == 150_060 and got[3].n_words == 1 and got[5].n_words == 0
    import math

    counts = collections.Counter(w for _, t in rows for w in (t or "").split())
    total, own = sum(counts.values()), collections.Counter(rows[1][1].split())
    assert got[2].log10_sum == pytest.approx(sum(n * math.log10(max(counts[w] - n, 0.5) / (total - 60)) for w, n in own.items()), abs=1e-6)
