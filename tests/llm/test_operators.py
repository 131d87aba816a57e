"""The ten operators against brute force, on small tables with nulls, empty and repeated rows, ties and odd columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("finlattice.llm.queries")
from finlattice.llm import lm, minhash, mixing, packing, quality, secret_scan, sharding, substring, topk, toxicity  # noqa: E402
from finlattice.llm.queries import vocabulary  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, spot string, part int, n int, size int, rank int"


def rows():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(400)] + ["Ünï", "ß", "of", "the"]
    make = lambda n: " ".join(rng.choice(vocab, n))
    base = make(120)
    texts = [base, base, base, base.replace("w1 ", "x ", 1), base.upper(), base + " tail words here", make(300) + " " + base, None, "", " \n\t ", "one", "One", "a b", "same " * 200, make(60) + "\nline\nline\n", "ab cd " * 50]
    texts += [make(int(n)) for n in rng.integers(1, 200, 30)]
    texts += ["x" * 5000, "é" * 300 + " it's <|endoftext|> 12 'tis"]
    out = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), 1, "a", 2, 3, 4, 5) for i, t in enumerate(texts)]
    return out + [out[0], out[5], (None, "null id", "en", "s1", 7, 1, "a", 2, 3, 4, 5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_sharding(docs, empty):
    got = sharding.digest(sharding.shuffled(docs, 24, bucket_bytes=2000)).collect()
    assert collections.Counter((r.doc_id, r.text_crc32, r["size"]) for r in got) == collections.Counter((r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 8) for r in rows())
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shuffled(empty, 24).count() == 0


def test_fisher_yates_is_a_permutation():
    assert sorted(sharding.fisher_yates(50, 1, 2)) == list(range(50)) and list(sharding.fisher_yates(50, 1, 2)) != list(range(50))


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    got = packing.pack(docs, vocabulary(), length=64).collect()
    got.sort(key=lambda r: (r.sequence_id, r.offset))
    line = 0
    for r in got:
        assert r.sequence_id * 64 + r.offset == line and r.offset + r.length <= 64
        line += r.length
    pieces = collections.defaultdict(bytes)
    want = collections.Counter(np.asarray(tok.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for r in rows())
    assert line * 4 == sum(len(k) * n for k, n in want.items())
    current = None
    for r in got:
        if r.start == 0:
            current = len(pieces)
        pieces[current] += r.ids
    assert collections.Counter(pieces.values()) == want
    assert packing.pack(empty, vocabulary()).count() == 0


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    path = grid[np.argsort(packing.hilbert(grid, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_substring(docs, empty):
    w = [words(r[1]) for r in rows()]
    c = collections.Counter(tuple(x[i : i + 35]) for x in w for i in range(len(x) - 34))
    want = []
    for r, x in zip(rows(), w, strict=True):
        gone = [False] * len(x)
        for i in range(len(x) - 34):
            if c[tuple(x[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want.append((r[0], len(x), sum(gone), hashlib.sha256(" ".join(y for y, g in zip(x, gone, strict=True) if not g).encode()).hexdigest()))
    got = [tuple(r) for r in substring.digest(substring.deduplicated(docs)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert substring.deduplicated(empty).count() == 0


def brute_quality(t, least):
    w = words(t)
    n = len(w)

    def covered(k):
        c = collections.Counter(tuple(w[i : i + k]) for i in range(n - k + 1))
        return {j for i in range(n - k + 1) if c[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}

    longest = 0
    for k in range(least, n):
        if not covered(k):
            break
        longest = k
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered(3)), len(covered(least)), longest


def test_quality(docs, empty):
    got = quality.quality_rules(docs).collect()
    for key, rs in (("a", sorted(got, key=lambda r: str(tuple(r)))),):
        have = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.covered_words, r.longest_repeat) for r in rs)
    assert have == collections.Counter((r[0], *brute_quality(r[1], 6)) for r in rows())
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and 100 * r.covered_words <= 30 * r.n_words and r.longest_repeat <= 200)
    assert quality.quality_rules(empty).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm(docs, empty, order):
    w = [words(r[1]) for r in rows()]
    grams = lambda x: collections.Counter(tuple(x[i : i + n]) for n in range(1, order + 1) for i in range(len(x) - n + 1))
    c = sum((grams(x) for x in w), collections.Counter())
    total = sum(map(len, w))
    want = []
    for r, x in zip(rows(), w, strict=True):
        own, s = grams(x), 0.0
        for i in range(len(x)):
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(x[i - n + 1 : i + 1])
                k = c[g] - own[g]
                if n == 1 or k > 0:
                    s += math.log10(max(k, 0.5) / (total - len(x)) if n == 1 else k / max(c[g[:-1]] - own[g[:-1]], k)) + (order - n) * math.log10(0.4)
                    break
        want.append((str(r[0]), len(x), round(s, 6)))
    got = [(str(r.doc_id), r.n_words, round(r.log10_sum, 6)) for r in lm.backoff_scores(docs, order, chunk_bytes=3000).collect()]
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4 for a, b in zip(sorted(got), sorted(want), strict=True))
    assert lm.backoff_scores(empty).count() == 0


def test_near_duplicates(docs, empty):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in rows():
        x = words((r[1] or "").translate(low))
        sets[r[0]] = set(zip(x, x[1:], strict=False)) if len(x) > 1 else {tuple(x)} if x else set()
    root = {i: i for i in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in root:
        for b in root:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for r in minhash.near_duplicates(docs).collect():
        assert r.n_shingles == len(sets[r.doc_id])
        if r.doc_id is not None:
            assert (r.component_id, r.kept) == (find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert minhash.near_duplicates(empty).count() == 0


def test_components_of_a_chain(spark):
    from finlattice.llm.work import Scratch

    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20], "a long, b long")
    got = {r.node: r.component for r in minhash.components(edges, Scratch(spark, "t")).collect()}
    assert all(got[i] == (0 if i <= 20 else 21) for i in got)
    assert set(range(1, 21)) | set(range(22, 41)) <= set(got)


def test_top_k(spark):
    rng = np.random.default_rng(5)
    v = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(400 + i, [1.0] * 8) for i in range(60)] + [(900, None), (920, [1.0, None] * 4), (940, [float("nan")] * 8)]
    df = spark.createDataFrame([(*x, 7) for x in v], "vec_id long, embedding array<float>, query_id int")
    use = [(i, [math.floor(64 * float(np.float32(x))) for x in e]) for i, e in v[:360]]
    want = []
    for q, a in use:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in use if i != q)[:20]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_secrets(spark, empty):
    token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    texts = [f'x token = "{token}" y', "card 4994226020900891 here", "commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b done", None, "", "plain words only"]
    df = spark.createDataFrame([(i, t, "src1", len(t or ""), 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long, candidate int")
    got = {(r.doc_id, r.candidate): r.is_secret for r in secret_scan.scan(df).collect()}
    assert got == {(0, token): True, (1, "4994226020900891"): False, (2, token): False}
    clean = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert clean == {i: t for i, t in enumerate(texts)} | {0: 'x token = "[SECRET]" y'}
    assert secret_scan.scan(empty).count() == 0


def test_secret_forest_on_unseen_findings(spark):
    model = secret_scan.train(secret_scan.labelled_findings(spark))
    from pyspark.ml.feature import VectorAssembler

    other = VectorAssembler(inputCols=secret_scan.FEATURES, outputCol="features").transform(secret_scan.features(secret_scan.labelled_findings(spark, 1000, seed=99)))
    assert model.transform(other).where("prediction = label").count() > 900


def test_mixing(docs, empty):
    mixed = mixing.mix(docs, block_tokens=300).collect()
    tokens = collections.Counter()
    for r in rows():
        tokens[r[3]] += max(1, len(words(r[1])))
    drawn = collections.Counter()
    for r in mixed:
        drawn[r.source] += r._tokens
    total = sum(tokens.values())
    w = mixing.tempered({s: n / total for s, n in tokens.items()}, mixing.exponent_for(tokens, total, 2.0))
    for s in tokens:
        assert drawn[s] >= w[s] * total - 1 and drawn[s] <= w[s] * total + 310
    assert mixing.mix(empty).count() == 0


def test_exponent_meets_its_goals():
    tokens = {"a": 1000, "b": 100, "c": 10}
    a = mixing.exponent_for(tokens, 1110, 2.0)
    w = mixing.tempered({s: n / 1110 for s, n in tokens.items()}, a)
    assert max(w[s] * 1110 / tokens[s] for s in tokens) == pytest.approx(2.0, rel=1e-6)
    a = mixing.exponent_for(tokens, 1110, 1e9, target_entropy=0.6)
    assert mixing.entropy(mixing.tempered({s: n / 1110 for s, n in tokens.items()}, a)) == pytest.approx(0.6 * math.log(3), rel=1e-6)


def test_grammar():
    follow, written = toxicity.grammar().table()

    def read(symbols):
        state, out = 0, []
        for s in symbols:
            out.append(int(written[state, s]))
            state = int(follow[state, s])
        return out

    o, i, h, t, n, r = range(6)
    assert read([o, i])[-1] == toxicity.INSULT and read([t, o, i])[-1] == toxicity.TARGETED and read([n, o, i])[-1] == toxicity.NEGATED
    assert read([r, o, i])[-1] == toxicity.REPORTED and read([h, o, t])[-1] == toxicity.MENACE and read([i, i]) == [toxicity.INSULT] * 2


def test_toxicity_held_out(spark, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.92 * len(got)
    assert not [r for r in got if r.predicted and not r.toxic]
    assert toxicity.toxicity(empty, labels.limit(0)).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 and r.predicted == 0 for r in toxicity.toxicity(none, labels).collect())


def test_pipeline_stages(spark):
    from finlattice.llm import stages as p

    sf = "/root/testdata/sf0.001"
    docs = p.table(spark, sf, "documents")
    for name, stage in p.STAGES[:-1]:
        out = p.Scratch(spark, "t").keep(stage(spark, docs, sf))
        assert out.columns == docs.columns, name
        docs = out
    last = p.STAGES[-1][1](spark, docs, sf)
    assert last.where("start = 0").count() == docs.count()


def test_pipeline_near_copies_go_by_five_words(spark):
    from finlattice.llm import stages as p

    form = [f"w{i}" for i in range(200)]
    filled = [x if i % 20 else f"name{i}" for i, x in enumerate(form)]
    texts = [" ".join(form), " ".join(filled), " ".join(form) + " end"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == {0: 0, 1: 0, 2: 0}
    assert sorted(r.doc_id for r in p.one_of_each_group(spark, df, "").collect()) == [0, 1]


def test_secrets_behind_long_names(spark):
    token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    long = "first line\nset " + "long_first_names/" * 9 + f' database_password_of_all = "{token}"'
    texts = [f'x\naws_secret_access_key = "{token}" y', f"{token} stripe_secret_api_key: {token}", long]
    df = spark.createDataFrame([(i, t, "src") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {(r.doc_id, r.before): r.is_secret for r in secret_scan.scan(df).where(f"candidate = '{token}'").collect()}
    tail = lambda t: t[: t.rindex(token)].rsplit("\n", 1)[-1][-48:]
    assert {k for k in got if k[1]} == {(i, tail(t)) for i, t in enumerate(texts)}
    assert all(v for k, v in got.items() if k[1])


def test_secrets_without_digits_and_in_assignments(spark):
    token, letters, words_ = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "kQzXvBnMwPdRtYhGfJcLsAeU", "CorrectHorseBatteryStaple"
    texts = [f"api_key={token} x", f"password: {words_}", f'token = "{letters}"', f"aws_secret_access_key={token}", "some/long/path/with/words/only", "-" * 60, "password=hunter2hunter2", "QUJDREVGR0hJSktMTU5PUA== x", "MIT! ERSCHSCHBERBERTZ der Schpfgegebeunger"]
    df = spark.createDataFrame([(i, t, "src") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    rs = secret_scan.scan(df).collect()
    got = {(r.doc_id, r.before, r.candidate): r.is_secret for r in rs}
    want = {(0, "api_key=", token): True, (1, "password: ", words_): True, (2, 'token = "', letters): True, (3, "aws_secret_access_key=", token): True, (4, "", texts[4]): False, (5, "", texts[5]): False}
    assert {k: got.get(k) for k in want} == want
    assert {k[1:] for k in got if k[0] == 6} == {("password=", "hunter2hunter2")} and {k[1:] for k in got if k[0] == 7} == {("", texts[7][:-2])}
    assert not got[(3, "", "aws_secret_access_key")] and [r.is_secret for r in rs if r.doc_id == 8] == [False, False]
    assert sorted(r.ordinal for r in rs if r.doc_id == 3) == [0, 1]
    clean = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert clean[0] == "api_key=[SECRET] x" and clean[1] == "password: [SECRET]"


def test_entropy_of_whole_candidates(spark):
    df = spark.createDataFrame([("", "a" * 256 + "b" * 256, "src")], "before string, candidate string, path string")
    r = secret_scan.features(df).first()
    assert (r.entropy, r.distinct) == (1.0, 2.0)


def test_registered_scores_use_trigrams(spark, tmp_path):
    from finlattice.llm.queries import queries

    spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.log10_sum for r in queries()["op6_lm_scores"](spark, str(tmp_path)).collect()]
    assert got == [round(math.log10(1 / 3) + 3 * math.log10(0.4), 6)] * 2


def test_toxicity_takes_any_number_of_strong_terms(spark):
    """Labels that follow the vocabulary: 6,000 words for either label, all of them strong."""
    rng = np.random.default_rng(6)
    make = lambda kind: " ".join(f"{kind}{i:05d}q" for i in rng.choice(6000, 900, replace=False))
    rows = [(i, make("ta" if i % 2 else "cl"), i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    assert got == {r[0]: r[2] for r in rows}


def test_covering_against_plain_sets():
    rng = np.random.default_rng(12)
    for trial in range(20):
        n_terms, n_texts, neg = 30, 80, 60
        holds = [sorted(set(rng.integers(0, n_terms, int(rng.integers(0, 8))).tolist())) for _ in range(n_texts)]
        negatives = rng.integers(0, 6, n_terms)
        open_, want = [set(x) for x in holds], []
        while True:
            left = np.asarray([sum(t in x for x in open_) for t in range(n_terms)], float)
            rest = max(1, sum(map(bool, open_)))
            base, gain = rest / (rest + neg), np.zeros(n_terms)
            for t in range(n_terms):
                n = left[t] + negatives[t]
                if left[t] >= 3 and left[t] / n >= 0.5:
                    gain[t] = left[t] * math.log(left[t] / (n * base)) + (negatives[t] * math.log(negatives[t] / (n * (1 - base))) if negatives[t] else 0)
            if gain.max() <= 1.0:
                break
            want.append(int(gain.argmax()))
            open_ = [x for x in open_ if want[-1] not in x]
        text, term = (np.asarray(x, np.int64) for x in ([i for i, x in enumerate(holds) for _ in x], [t for x in holds for t in x]))
        assert toxicity.covering(text, term, negatives, neg, 1.0).tolist() == sorted(want)
    assert len(toxicity.covering(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 5, 1.0)) == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_top_k_of_any_finite_components(spark, kind):
    rng = np.random.default_rng(31)
    sizes = [1.0, 1e9, 1e10, 1e30] + ([1e100, 1e300] if kind == "double" else [])
    v = [(i, (rng.normal(size=3) * sizes[i % len(sizes)]).tolist()) for i in range(90)]
    v += [(100, [1e9, 1.0, 0.0]), (101, [1e9, 2.0, 0.0]), (120, [-1e10, 1e10, 1e10]), (121, [1e30, -1e30, 1e30]), (140, [0.0] * 3), (141, [1e30, -1e30, 1e30]), (160, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame(v, f"vec_id long, embedding array<{kind}>")
    as_read = lambda x: float(np.float32(x)) if kind == "float" else x
    use = [(i, [math.floor(64 * as_read(x)) for x in e]) for i, e in v if i != 160]
    want = []
    for q, a in use:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in use if i != q)[:20]
            want += [(q, n + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)


def test_places_keep_the_order_of_scores():
    xs = sorted({s * ((1 << b) + d) for b in (3, 50, 60, 61, 62, 63, 64, 100, 101, 2100) for d in (-1, 0, 1, 5) for s in (-1, 1)})
    assert [topk.place_of(x) for x in xs] == sorted(topk.place_of(x) for x in xs)
    assert sorted(xs, key=lambda x: (topk.place_of(x), topk.written(x))) == xs
    assert max(abs(topk.place_of(x)) for x in xs) < 1 << 62


CLASHING = "_metadata string, _key int, _found int, __spot int, __src int, __size int, _block int, _epoch string, spot_ int, c0 int, src int, twice int, content int, row int, k int, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Copied rows (by a join), and columns named like anything the operators use inside."""
    out = spark.createDataFrame([(r[0], r[1], r[2], r[3], "m", 1, 2, 3, 4, 5, 6, "e", 7, 8, 9, 10, 11, 12, 13, r[4]) for r in rows()], "doc_id long, text string, lang string, source string, " + CLASHING)
    return out.crossJoin(spark.range(2).select(F.col("id").alias("copy")))


def brute_spots(rows_, columns, seed, at):
    """What spotted() says: content by md5, 15 digits of it; no repeated rows here."""
    for r in rows_:
        said = "|".join("-" if r[at[c]] is None else "+" + hashlib.md5(str(r[at[c]]).encode()).hexdigest() for c in columns)
        yield int(hashlib.md5(f"{seed}|{said}".encode()).hexdigest()[:15], 16)


def test_sharding_by_brute_force(spark):
    once = [r for r in dict.fromkeys(rows()) if r[0] is not None]
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffled(spark.createDataFrame(once, SCHEMA), 5, seed=3, bucket_bytes=2000).collect()}
    size = sum(len((r[1] or "").encode()) + 8 for r in once)
    n = -(-size // 2000)
    buckets = collections.defaultdict(list)
    for r, spot in zip(once, brute_spots(once, ["doc_id", "text"], 3, {"doc_id": 0, "text": 1}), strict=True):
        buckets[(spot >> 20) % n].append((spot, r[0]))
    line = []
    for b in sorted(buckets):
        own = [i for _, i in sorted(buckets[b])]
        line += [own[j] for j in sharding.fisher_yates(len(own), 3, b)]
    edge = [s * len(line) // 5 for s in range(6)]
    assert got == {i: (s, k - edge[s]) for s in range(5) for k, i in enumerate(line[edge[s] : edge[s + 1]], edge[s])}


def same(df_a, df_b):
    return collections.Counter(map(str, df_a.collect())) == collections.Counter(map(str, df_b.collect()))


def test_seeds_give_one_result_wherever_rows_lie(spark, docs, tmp_path):
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    once.repartition(7).write.parquet(f"{tmp_path}/a")
    once.coalesce(1).write.parquet(f"{tmp_path}/b")
    a, b = (spark.read.parquet(f"{tmp_path}/{x}") for x in "ab")
    assert same(sharding.shuffled(a, 5, bucket_bytes=2000), sharding.shuffled(b, 5, bucket_bytes=2000))
    assert same(mixing.digest(mixing.mix(a, block_tokens=300)), mixing.digest(mixing.mix(b, block_tokens=300)))
    assert same(packing.digest(packing.pack(a, vocabulary(), length=64)), packing.digest(packing.pack(b, vocabulary(), length=64)))
    assert same(mixing.mix(docs, block_tokens=300), mixing.mix(docs, block_tokens=300))


def test_copied_rows_and_clashing_names(odd, tmp_path):
    n = odd.count()
    assert sharding.shuffled(odd, 5, bucket_bytes=2000).count() == n
    assert packing.pack(odd, vocabulary(), length=64).where("start = 0").count() == n
    got = collections.Counter(r.doc_id for r in substring.deduplicated(odd).collect())
    assert sum(got.values()) == n and got[3] == 2
    assert substring.deduplicated(odd).where("n_words >= 35 and n_removed < n_words").count() == 0
    mixed = mixing.mix(odd, block_tokens=300)
    assert sorted(mixed.columns) == sorted([*(c for c in odd.columns if c not in ("_epoch", "_block")), "_epoch", "_block", "_order", "_tokens"])
    odd.write.parquet(f"{tmp_path}/odd")
    again = mixing.mix(odd.sparkSession.read.parquet(f"{tmp_path}/odd"), block_tokens=300)
    assert abs(mixed.count() - again.count()) <= 2
    for f in (quality.quality_rules, minhash.near_duplicates, lambda d: lm.backoff_scores(d, chunk_bytes=3000)):
        assert f(odd).count() == n
    assert secret_scan.redact(odd).columns == odd.columns and secret_scan.redact(odd).count() == n


def test_mixing_by_brute_force(spark):
    """Exact draws: ties of sizes, a null source, a long text, texts without words."""
    once = [r for r in dict.fromkeys(rows()) if r[0] is not None] + [(500, "long " * 9000, "en", "s2", 1, 1, "a", 2, 3, 4, 5)]
    limit, seed = 300, 41
    size = {r[0]: max(1, len(words(r[1]))) for r in once}
    src = {r[0]: "null" if r[3] is None else f"s:{r[3]}" for r in once}
    spot = dict(zip((r[0] for r in once), brute_spots(once, ["doc_id", "text", "source"], seed, {"doc_id": 0, "text": 1, "source": 3}), strict=True))
    tokens = {s: sum(size[i] for i in size if src[i] == s) for s in sorted(set(src.values()))}
    total = sum(tokens.values())
    w = mixing.tempered({s: n / total for s, n in tokens.items()}, mixing.exponent_for(tokens, total, 2.0))
    turn = lambda *x: int(hashlib.md5("|".join(map(str, x)).encode()).hexdigest()[:15], 16)
    want = collections.Counter()
    for s, n in tokens.items():
        full, rest, blocks = int(w[s] * total) // n, int(w[s] * total) % n, -(-n // limit)
        held = collections.defaultdict(list)
        for i in size:
            if src[i] == s:
                held[spot[i] % blocks].append((spot[i], i))
        times = {i: full for b in held.values() for _, i in b}
        for b in sorted(held, key=lambda b: (turn(seed, s, full, b), b)):
            for _, i in sorted(held[b]):
                if rest > 0:
                    times[i] += 1
                    rest -= size[i]
        for b, own in held.items():
            for _, i in own:
                for e in range(times[i]):
                    want[(i, e, b, turn(seed, s, e, b), size[i])] += 1
    got = mixing.mix(spark.createDataFrame(once, SCHEMA), block_tokens=limit, seed=seed).collect()
    assert collections.Counter((r.doc_id, r._epoch, r._block, r._order, r._tokens) for r in got) == want


def planted_secrets():
    """Lines of many kinds: (line, the finding, is it a secret)."""
    rng = np.random.default_rng(12)
    pick = lambda letters, n: "".join(rng.choice(list(letters), n))
    low, up, num, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    out = []
    for _ in range(20):
        word = [str(w) for w in rng.choice(secret_scan.DICTIONARY, 4)]
        yes = [f'password = "{"-".join(word)}"', f'api_key="{pick(low + up, 24)}"', f"password: {pick(low, 5)}{pick(num, 3)}!", f'secret_key = "{pick(low + up, 70)}{pick(num, 8)}"', f"auth: eyJ{pick(low + up + num, 33)}.{pick(low + up + num, 60)}.{pick(low + up + num + '-_', 43)}",
               f"AKIA{pick(up + num, 16)}", f"ghp_{pick(low + up + num, 36)}", f"export TOKEN={pick(hexa, 40)}", f"sk_live_{pick(low + up + num, 24)}", f"passwd='{pick(low + up + num, 9)}#{pick(num, 2)}'"]
        no = [f"commit {pick(hexa, 40)}", f"card {pick(num, 16)}", f"see {'/'.join(word)}/index", f"id {pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}", "password: required", f"sha256: {pick(hexa, 64)}", "-" * 40, "password: ********", f"the_{'_'.join(word)}_of", f"token = <your_{word[0]}>"]
        out += [(f"{word[0]} {x} {word[1]}", x, True) for x in yes] + [(f"{word[0]} {x} {word[1]}", x, False) for x in no]
    return out


def test_planted_secrets_of_many_kinds(spark):
    lines = planted_secrets()
    df = spark.createDataFrame([(i, x[0], "src") for i, x in enumerate(lines)], "doc_id long, text string, source string")
    said = collections.defaultdict(bool)
    for r in secret_scan.scan(df).collect():
        said[r.doc_id] |= r.is_secret
    recall = np.mean([said[i] for i, x in enumerate(lines) if x[2]])
    precision = np.mean([x[2] for i, x in enumerate(lines) if said[i]])
    assert recall >= 0.9 and precision >= 0.9, (recall, precision, [x[1] for i, x in enumerate(lines) if said[i] != x[2]])


def test_features_by_brute_force(spark):
    rows_ = [("say api_key = '", "abcDEF012345wordtime++", "tests/a"), ("", "p@ss!w0rd", None), ("id=", "a" * 3000 + "Z9", "app/conf")]
    got = [r.asDict() for r in secret_scan.features(spark.createDataFrame(rows_, "before string, candidate string, path string").coalesce(1)).collect()]
    long_first = "|".join(sorted(secret_scan.DICTIONARY, key=lambda w: (-len(w), w)))
    for (before, c, path), r in zip(rows_, got, strict=True):
        kind = lambda x: "a" if x.islower() else "b" if x.isupper() else "0" if x.isdigit() else "_"
        n = len(c)
        share = [c.count(x) / n for x in set(c)]
        want = {
            "length": n, "distinct": len(set(c)), "digits": sum(x.isdigit() for x in c) / n, "uppers": sum(x.isupper() for x in c) / n, "hexish": sum(x in "0123456789abcdef" for x in c) / n,
            "turns": sum(kind(a) != kind(b) for a, b in zip(c, c[1:], strict=False)) / n, "entropy": -sum(p * math.log2(p) for p in share), "dictionary": (n - len(re.sub(long_first, "", c.lower()))) / n,
            "assigned": bool(re.search(r"[=:]\s*[\"'`]?$", before)), "quoted": before.endswith(("'", '"', "`")), "said_secret": "api_key" in before, "said_other": before == "id=", "symbols": sum(not x.isalnum() for x in c) / n,
            "test_path": path == "tests/a", "config_path": path == "app/conf",
        }
        assert {k: round(float(v), 9) for k, v in want.items()} == {k: round(r[k], 9) for k in want}


def test_redaction_by_place(spark):
    token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    texts = [f'commit {token} then token = "{token}" and {token}ff00 end', f'token = "{token}"', f'token = "{token}"', None, ""]
    df = spark.createDataFrame([(7, t, "s", -1, 3) for t in texts], "doc_id long, text string, source string, n_chars long, row int")
    got = sorted((str(r.text), r.n_chars, r.row) for r in secret_scan.redact(df).collect())
    first = f'commit {token} then token = "[SECRET]" and {token}ff00 end'
    assert got == sorted([(first, len(first), 3), ('token = "[SECRET]"', 18, 3), ('token = "[SECRET]"', 18, 3), ("None", -1, 3), ("", -1, 3)])


def test_lm_numbers_are_whole():
    x = np.asarray([0, 5, 2**32 + 5, 2**63 - 1], np.int64)
    assert (lm.expand(lm.squeeze(x)) == x).all() and len(lm.expand(lm.squeeze(x[:0]))) == 0
    keys = np.asarray([3, 2**40, 2**64 - 1], np.uint64)
    assert (lm.unpack_keys(lm.pack_keys(keys)) == keys).all() and lm.part_of(keys, 7).tolist() == [0, 0, 6]


def test_pipeline_by_stages(spark, tmp_path):
    """Null, empty, repeated rows and repeated ids with other texts, stage by stage against plain Python; then an empty table."""
    from finlattice.llm import stages as p

    schema = "doc_id long, text string, lang string, source string, n_chars long, _key int"
    low = [r[:5] for r in rows()]
    low += [(3, "quite another text under the number of a text above " * 3, "en", "s1", 9), (None, None, "en", "s2", 0), (900, " ".join(f"u{i}" for i in range(80)), "en", "s2", 9), (901, " ".join(f"u{i}" for i in range(80)) + " end", "en", "s2", 9)]
    docs = spark.createDataFrame([(*r, 1) for r in low], schema)
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = p.drop_toxic(spark, docs, str(tmp_path))
    assert collections.Counter(map(tuple, clean.collect())) == collections.Counter(low)
    # near copies by 5-word sets, over rows
    case = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in low:
        x = words((r[1] or "").translate(case))
        sets.append({tuple(x[i : i + 5]) for i in range(len(x) - 4)} if len(x) >= 5 else {tuple(x)} if x else set())
    root = list(range(len(low)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(low)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(low):
        groups[find(i)].append(r)
    kept = [tuple(r) for r in p.one_of_each_group(spark, docs, "").collect()]
    assert len(kept) == len(groups)
    assert all(any(r in g for r in kept) for g in groups.values())
    assert (900, low[-2][1], "en", "s2", 9) in kept and (901, low[-1][1], "en", "s2", 9) not in kept and low[-4] in kept
    hidden = [tuple(r) for r in p.hide_secrets(spark, docs, "").collect()]
    assert len(hidden) == len(low) and sum(a != b for a, b in zip(sorted(hidden, key=str), sorted(low, key=str), strict=True)) == 0
    assert {r.doc_id for r in p.mix_sources(spark, docs, "").collect()} <= {r[0] for r in low}
    empty = docs.limit(0)
    for name, stage in p.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_top_k_in_a_grid(spark, monkeypatch):
    """Many small cells, no broadcast, vectors of two lengths, one vector in a third of the rows, repeated and clashing names."""
    for name, n in (("QUERY_BLOCK", 8), ("ROW_BLOCK", 16), ("CELL_QUERIES", 2), ("CELL_ROWS", 3)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(8)
    v = [(i, ([1.0] * 4 if i % 3 == 0 else rng.normal(size=4 if i % 5 else 2).tolist())) for i in range(500)]
    df = spark.createDataFrame([(*x, 1, 2) for x in v], "vec_id long, embedding array<double>, q_block int, v int")
    use = [(i, [math.floor(64 * x) for x in e]) for i, e in v]
    want = []
    for q, a in use:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in use if i != q and len(a) == len(b))[:7]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(tuple(r) for r in topk.top_k(df, 7).collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_near_duplicates_of_hot_groups(spark):
    """A third of the rows are exact copies, a third near copies of one text, and filled templates share bands without links."""
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(120)]
    form = [f"f{i}" for i in range(120)]
    texts = ["copy of one text " * 9] * 60
    for i in range(60):
        x = list(base)
        x[int(rng.integers(120))] = f"n{i}"
        texts.append(" ".join(x))
    for i in range(60):
        x = list(form)
        for j in rng.choice(120, 6 + i % 5, replace=False):
            x[j] = f"t{i}_{j}"
        texts.append(" ".join(x))
    texts += ["", None, "x " * 30_000]
    sets = []
    for t in texts:
        x = words(t)
        sets.append(set(zip(x, x[1:], strict=False)))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def longest_elsewhere(texts, t, i):
    """Words from position i of text t that stand anywhere else too, at most."""
    best, x = 0, texts[t]
    for u, y in enumerate(texts):
        for j in range(len(y)):
            if (u, j) != (t, i):
                n = 0
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                    n += 1
                best = max(best, n)
    return best


@pytest.mark.parametrize("kinds", [256, 2])
def test_factors_by_a_brute_force_parser(spark, monkeypatch, kinds):
    """Passages that repeat whole, in part, shifted, across other joints and within a text; few kinds of a phrase in a block, or many."""
    monkeypatch.setattr(substring, "MAX_KINDS", kinds)
    rng = np.random.default_rng(6)
    make = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    a, b, c = make(60), make(50), make(9)
    texts = [make(5) + a + make(4), a[3:50] + make(30), make(7) + a[20:] + b[:30] + make(2), b[10:] + make(3) + b[:40], a[5:45] + c + a[10:50], c * 9, make(34), make(40)]
    texts += [make(3) + a[i : i + 38] + make(6) for i in range(0, 20, 3)] + [["x"] * 50, make(20) + b[5:45] + a[:36]]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in substring.factors(df).collect():
        got[r.doc_id].append((r.start, r.size))
    for t, x in enumerate(texts):
        spans, i, want = got[t], 0, [False] * len(x)
        while i < len(x):  # the greedy parse, and each window across a boundary
            n = longest_elsewhere(texts, t, i)
            if n >= 35:
                want[i : i + n] = [True] * n
            i += 1
        covered = [False] * len(x)
        for lo, size in spans:
            assert size >= 35 and longest_elsewhere(texts, t, lo) >= size
            covered[lo : lo + size] = [True] * size
        assert covered == want, t


def brute_toxic(text, lexicon):
    """The grammar in plain Python: per clause, what each insult, threat and target comes to."""
    out = collections.Counter()
    for clause in re.split(r"[.!?;:\n|]", text.lower()):
        said = negated = threatened = near = insulted = 0
        for w in re.findall(r"[a-z\u0080-￿']+", clause):
            kind = "insult" if w in lexicon else next((k for k, v in (("threat", toxicity.THREATS), ("target", toxicity.TARGETS), ("report", toxicity.REPORTS), ("not", toxicity.NEGATIONS)) if w in v), "")
            weight = lexicon.get(w, 1.0)
            if kind == "insult" and said:
                out[toxicity.REPORTED] += weight
                kind = ""
            if kind == "threat" and said:
                out[toxicity.RETOLD] += weight
                kind = ""
            if kind == "insult" and negated:
                out[toxicity.NEGATED] += weight
                kind = ""
            menace = kind == "target" and threatened
            if menace:
                out[toxicity.MENACE] += weight
            if kind == "insult":
                out[toxicity.TARGETED if near else toxicity.INSULT] += weight
            if kind == "target" and not menace and insulted:
                out[toxicity.AIMED] += weight
            plain_target = kind == "target" and not menace
            said = said or kind == "report"
            negated = toxicity.NEGATION_REACH if kind == "not" else max(0, negated - 1)
            threatened = 0 if menace else toxicity.THREAT_REACH if kind == "threat" else max(0, threatened - 1)
            if plain_target:
                near, insulted = toxicity.TARGET_REACH, 0
            elif kind == "insult":
                near, insulted = max(0, near - 1), 0 if near else toxicity.TARGET_REACH
            else:
                near, insulted = max(0, near - 1), max(0, insulted - 1)
    return [out[s] for s in toxicity.SCORED]


def test_toxic_features_by_brute_force():
    lexicon = {"dolt": 2.0, "oaf": 1.5, "blödian": 1.0}
    by = sorted(lexicon, key=lambda w: toxicity.hashed([w])[0])
    feature = toxicity._features((toxicity.hashed(list(lexicon)), np.asarray([lexicon[w] for w in by])))
    rng = np.random.default_rng(9)
    pool = [*lexicon, "you", "not", "said", "kill", "tree", "Tu", "house", ".", "\n", "walks", "DOLT", "oafish"]
    texts = [" ".join(rng.choice(pool, n)) for n in rng.integers(0, 60, 200)] + ["", "dolt you", "you dolt", "tree " * 40_000 + "you dolt"]
    raw = [t.lower().encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(x) for x in raw]))
    got = feature(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert got.tolist() == [brute_toxic(t, lexicon) for t in texts]


def test_toxicity_of_repeated_rows_and_clashing_names(odd, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    n = odd.count()
    got = toxicity.toxicity(odd.withColumns({"score": F.lit("x"), "predicted": F.lit("y")}), labels).collect()
    assert len(got) == n and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.without_toxic(odd.select("doc_id", "text", "_key"), odd, labels)
    assert kept.columns == ["doc_id", "text", "_key"] and kept.count() <= n


def test_secrets_in_very_long_texts(spark):
    token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    texts = [".".join(["abcdefgh12345678"] * 30_000), "x" * 300_000 + f' token = "{token}"', "password=" + "p!" * 100_000, (f"commit {token} " * 3000)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    n = collections.Counter(r.doc_id for r in secret_scan.scan(df).collect())
    assert n == {0: 1, 1: 2, 2: 1, 3: 3000}
    assert {r.doc_id: r.text for r in secret_scan.redact(df).collect()}[1] == "x" * 300_000 + ' token = "[SECRET]"'


def test_packing_by_brute_force(spark):
    """Token counts, hashed and projected, standardised, cut into cells, in Hilbert order, laid end to end."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    once = [r for r in dict.fromkeys(rows()) if r[0] is not None]
    ids = {r[0]: tok.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in once}
    table = packing.projection(max(tok.get_vocab_size(), 2), 29)
    point = {i: np.asarray([np.float64(np.add.reduceat(table[x, d], [0])[0] / len(x)) for d in range(packing.DIMS)]) for i, x in ids.items()}
    every = np.stack(list(point.values()))
    spot = dict(zip((r[0] for r in once), brute_spots(once, ["doc_id", "text"], 29, {"doc_id": 0, "text": 1}), strict=True))
    cells = {i: [min(1023, int(1024 / (1 + math.exp(-1.7 * (p[d] - every[:, d].mean()) / every[:, d].std())))) for d in range(3)] for i, p in point.items()}
    key = {i: (int(packing.hilbert(np.asarray([c]), packing.BITS)[0]) << 32) | (spot[i] & 0xFFFFFFFF) for i, c in cells.items()}
    line, want = 0, set()
    for i in sorted(ids, key=lambda i: (key[i], i)):
        start = 0
        while start < len(ids[i]):
            n = min(len(ids[i]) - start, 64 - line % 64)
            want.add((i, start, n, np.asarray(ids[i][start : start + n], "<u4").tobytes(), len(ids[i]), line // 64, line % 64))
            start, line = start + n, line + n
    got = packing.pack(spark.createDataFrame(once, SCHEMA), vocabulary(), length=64).collect()
    assert {(r.doc_id, r.start, r.length, bytes(r.ids), r.doc_tokens, r.sequence_id, r.offset) for r in got} == want


def test_quality_of_long_repeats(spark):
    """One text of 200,000 equal words, and one that repeats a passage of 60,000."""
    passage = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, "a " * 200_000), (2, f"{passage} x {passage}")], "doc_id long, text string")
    got = {r.doc_id: (r.covered_words, r.longest_repeat) for r in quality.quality_rules(df).collect()}
    assert got == {1: (200_000, 199_999), 2: (120_000, 60_000)}


def test_pipeline_leaves_one_table(spark, tmp_path, monkeypatch):
    from finlattice.llm import stages, work

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work.shared_dir(type("S", (), {"conf": type("C", (), {"get": lambda *a: None})(), "sparkContext": type("X", (), {"master": "local-cluster[2,1,1024]"})})())
    monkeypatch.setattr(work, "shared_dir", lambda s: f"file://{tmp_path}/shared")
    out = stages.run(spark, "/root/testdata/sf0.001")
    assert out.where("start = 0").count() > 60
    folders = list((tmp_path / "shared/llm").iterdir())
    assert [f.name.split("-")[0] for f in folders] == ["pipeline"] and [f.name for f in folders[0].iterdir() if not f.name.startswith(".")] == ["005"]
