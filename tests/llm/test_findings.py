"""Windows of the personal-data model: those left out can't hold anything, and spans longer than a window are found."""

import random

import numpy as np

from finlattice.llm import pii


def spans_of(texts, which):
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    c, at = pii.characters(data, offsets)
    first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    flat = "".join(texts)
    return sorted((k, s, e, flat[s:e]) for k, s, e in pii.learned(pii.train(), c, at, data, first, pii.Base(c, at).spans(), which=which))


def test_every_window_that_can_hold_something_is_read():
    rng = random.Random(3)
    texts = ["write to anna at mail.example.com now", "mail " + "verylongname." * 9 + "smith at example.org, thanks", "anna ( at ) example (dot) com", "9 8 7 " * 400]
    texts += ["".join(rng.choice(["an", "na ", " at ", ".", "é", "(at)", "@", "7", "12", " ", "-", "com"]) for _ in range(rng.randrange(300))) for _ in range(60)]
    got = spans_of(texts, pii.windows)
    assert got == spans_of(texts, pii.grid)
    assert any(x[3] == "anna at mail.example.com" for x in got)
