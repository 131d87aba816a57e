"""Cross-tokenizer alignment against a plain merge over the tokenizers' own ids."""

import collections
import hashlib
import re

import pyarrow as pa
import pytest

queries = pytest.importorskip("finlattice.llm.queries")
from finlattice.llm import alignment  # noqa: E402
from finlattice.llm.tokens import byte_letters  # noqa: E402

A, B = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")
ODD = ["plain text here", "trailing ", "two  spaces  ", "\n\n x\t\t y \n", "", " ", None, "x" * 3000, "é" * 40 + " ü", "日本語 テキスト 日本", "▁under ▁x", "<|endoftext|> is plain <s> </s> <0x41>", "it's 12,345.67 — “quotes” nbsp  wide　", "a\u0085b c", "\0nul \0", "emoji 👩‍👩‍👧 🇩🇪 ok", "plain text here", "ab " * 200, "word " * 9000 + "end"]


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = {c: i for i, c in enumerate(byte_letters())}
    of_a = lambda i: bytes(byte_of[c] for c in a.id_to_token(i))
    of_b = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
    count, made = collections.Counter(), []
    for doc_id, text in rows:
        x, y, whole = [], [], (" " + (text or "")).encode()
        if text:
            x = [(i, of_a(i)) for i in a.encode(" " + text, add_special_tokens=False).ids]
            y = [(i, of_b(b.id_to_piece(i))) for i in b.encode(text)]
        if not text or b"".join(t for _, t in x) != whole or b"".join(t for _, t in y) != whole:
            made.append((doc_id, [], [], [], []))
            continue
        groups, own_a, own_b, i, j, at_a, at_b = [], [], [], 0, 0, 0, 0
        while i < len(x) or j < len(y):
            if at_a <= at_b and i < len(x):
                at_a, i = at_a + len(x[i][1]), i + 1
                own_a.append(x[i - 1][0])
            else:
                at_b, j = at_b + len(y[j][1]), j + 1
                own_b.append(y[j - 1][0])
            if at_a == at_b and own_a and own_b:
                groups.append((own_a, own_b))
                own_a, own_b = [], []
        links = [(p, q) for g, h in groups for p in g for q in h]
        count.update(set(links))
        made.append((doc_id, x, y, groups, links))
    top = collections.Counter()
    for (p, _), n in count.items():
        top[p] = max(top[p], n)
    for doc_id, x, y, groups, links in made:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        yield (doc_id, len(x), len(y), len(groups), len(links), sum(count[k] == top[k[0]] for k in links), sum(count[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if x else "")


def aligned(df):
    return sorted((tuple(r) for r in alignment.align(df, A, B).collect()), key=str)


def test_odd_texts(spark):
    rows = [*enumerate(ODD), (0, ODD[0]), (None, "no id, plain text"), (None, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, units int, chunk int").repartition(3)
    assert aligned(df) == sorted(brute(rows), key=str)


def test_chunks_of_any_size_agree(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).select("doc_id", "text").collect()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(brute([tuple(r) for r in docs]), key=str)
    assert aligned(df) == want
    monkeypatch.setattr(alignment, "_MANY", 2)  # in this process only; the merge of many links is tested below
    pair = alignment.Pair.of(A, B)
    texts = [r.text for r in docs if r.text]
    units = pa.array(sorted({" " + w for t in texts for w in t.split(" ")} - {" "}), pa.large_string())
    few = alignment.Chunk(pair, units)
    monkeypatch.setattr(alignment, "_MANY", 1 << 40)
    all_ = alignment.Chunk(pair, units)
    assert all(links_of(few, u) == links_of(all_, u) for u in range(len(units))) and few.text == all_.text and (few.links == all_.links).all()


def links_of(c, unit):
    out = collections.Counter()
    for k in range(c.first[unit], c.first[unit + 1]):
        out[int(c.pairs[c.place[k]])] += int(c.times[k])
    return out


def test_tables_without_tokens(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert aligned(df) == [(1, *[0] * 6, ""), (2, *[0] * 6, ""), (2, *[0] * 6, "")]
    assert aligned(df.limit(0)) == []
