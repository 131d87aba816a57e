"""Personal data: base spans against plain patterns, the model on unseen spans, other spellings, odd rows."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("finlattice.llm.queries")
from finlattice.llm import pii  # noqa: E402

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, t):
    d = [int(x) for x in t if x in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in t.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def brute(t):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if valid(k, m[0])]


def base_of(texts):
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    c, at = pii.characters(data, offsets)
    kind, s, e = pii.Base(c, at).spans()
    doc = np.searchsorted(at[1:], s, side="right")
    return sorted((int(d), pii.KINDS[k], int(x - at[d]), int(y - at[d])) for d, k, x, y in zip(doc, kind, s, e, strict=True))


ODD = ["a@b.c@d.e", "x@y", "@a.b", "a@.b", "a@b..c", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "001.2.3.255", "1.2.3.256", "9" * 40 + ".1.1.1", "4111 1111-1111 1111", "4111  1111 1111 1111", "+1", "+12", "+1 2", "+1 (743) 555-3824.", "+(1) 2", "+1 22 333 4444 5555 66 7", "é@b.c", "ü+49 30 1234567", "4313901234567890", "+", "@", "1", "", "a@b.c", "5.5.5.5", "+3 44 55 66 77", "-", "."]


def test_base_spans():
    assert base_of(ODD) == sorted((i, *s) for i, t in enumerate(ODD) for s in brute(t))
    assert base_of([]) == base_of([""]) == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("a.@+-() 0123456789é\n"), max_size=60), max_size=4))
def test_base_spans_of_any_text(texts):
    assert base_of(texts) == sorted((i, *s) for i, t in enumerate(texts) for s in brute(t))


def test_long_runs_take_no_longer_than_others():
    texts = ["x" * 2_000_000, "1" * 2_000_000, "@" * 100_000, "1." * 300_000, "+1" * 300_000, "a@" * 100_000]
    assert len([s for s in base_of(texts) if s[0] == 3]) == 75_000


def test_model_on_unseen_spans():
    rows = pii.labelled_spans(600, seed=4242, length=pii.WINDOW)
    path, _ = pii.train().decode(pii._symbols([t for t, _ in rows], pii.WINDOW))
    hit = said = there = 0
    for (_, spans), p in zip(rows, path, strict=True):
        got = {(int(p[j]) // 2, j, j + 1 + len(re.match("i*", "".join("i" if x and x % 2 == 0 else "." for x in p[j + 1 :]))[0])) for j in range(len(p)) if p[j] % 2 == 1}
        inner = lambda s: {x for x in s if x[1] > 0 and x[2] < pii.WINDOW}
        hit, said, there = hit + len(inner(got) & inner(set(spans))), said + len(inner(got)), there + len(inner(set(spans)))
    assert hit >= 0.95 * said and hit >= 0.95 * there


def test_reconciled_spans_do_not_overlap_and_weigh_most():
    spans = [(0, 0, 10, 5.0), (1, 8, 12, 4.0), (2, 10, 20, 3.0), (0, 0, 10, 2.0), (3, 30, 40, 1.0)]
    assert pii.reconciled(spans) == [(0, 0, 10), (2, 10, 20), (3, 30, 40)]
    assert pii.reconciled([]) == []


PROSE = "Enung das chber enö der pf und lichung erlichäer keit von geteü teach an thing the of erea. "


def test_other_spellings_in_whole_texts(spark):
    said = ["call (743) 555-3824 now", "mail anber.st@mail3.example.com or lin (at) kastion.org please", "host 10[.]20[.]30[.]40 down", "card 4111.1111.1111.1111 ok", "born 2024-03-07 at 10:30, v1.2.3, no 1234567890, token 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]
    texts = [PROSE * 3 + x + ". " + PROSE * 2 for x in said] + [PROSE * 700 + said[0] + PROSE * 700]
    schema = "doc_id long, text string, spans string, kind int, start int"
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], schema)
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end], s.learned) for s in r.spans] for r in pii.find(df).collect()}
    assert got[0] == got[5] == [("phone", "(743) 555-3824", True)]
    assert got[1] == [("email", "anber.st@mail3.example.com", False), ("email", "lin (at) kastion.org", True)]
    assert got[2] == [("ip", "10[.]20[.]30[.]40", True)] and got[3] == [("card", "4111.1111.1111.1111", True)] and got[4] == []
    clean = {r.doc_id: r.text for r in pii.masked(pii.find(df)).collect()}
    assert clean[0] == texts[0].replace("(743) 555-3824", "[PHONE]") and clean[4] == texts[4]


def test_digest(spark):
    rows = [*enumerate(ODD), (1, None), (None, "a@b.c +49 30 1234567"), (7, ODD[7]), (99, "é" * 5000 + " 1.2.3.4")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = []
    for i, t in rows:
        b = brute(t)
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
        want.append((str(i), *(sum(x[0] == k for x in b) for k in PATTERNS), hashlib.sha256(line.encode()).hexdigest()))
    got = pii.digest(pii.find(df)).collect()
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    assert all(hashlib.sha256(",".join(x for x in r.spans.split(",")).encode()).hexdigest() == r.base_sha256 or len(r.spans.split(",")) > r.n_email + r.n_ip + r.n_card + r.n_phone for r in got)
    assert pii.digest(pii.find(df.limit(0))).count() == 0
