"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds other spellings."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T
from .work import frugal, passes, ship, text_of

KINDS = ["email", "ip", "card", "phone"]
#: Tags: none, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
#: Characters of a window; windows begin every half window, so a span of half a window lies whole in one at least.
WINDOW = 96
#: Hidden numbers per direction, labelled windows and their length, passes over them.
HIDDEN, LABELLED, LENGTH, EPOCHS = 24, 4096, 72, 4
_NO = -1e9
_flags = lambda chars: np.isin(np.arange(256), np.frombuffer(chars, np.uint8))
_ALNUM = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_DIGIT, _LOCAL, _LABEL, _DIAL = _flags(b"0123456789"), _flags(_ALNUM + b"._%+-"), _flags(_ALNUM + b"-"), _flags(b" ().-0123456789")


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte per code point (its first in UTF-8) of the texts of a pass, and where each text begins."""
    first = (data & 0xC0) != 0x80
    return data[first], np.append(0, np.cumsum(first))[offsets]


def luhn(digits: bytes) -> bool:
    d = [b - 48 for b in digits][::-1]
    return sum(d[::2]) % 10 == -sum(2 * x // 10 + 2 * x % 10 for x in d[1::2]) % 10


def _small(part: bytes) -> bool:
    """A number of at most 255, however many zeros it begins with."""
    p = part.lstrip(b"0")
    return len(p) <= 2 or len(p) == 3 and p <= b"255"


class Base:
    """The fixed patterns over all texts of a pass, from runs of characters: no step goes back, however long a run is."""

    def __init__(self, c: np.ndarray, at: np.ndarray):
        self.c, self.at, n = c, at, len(c)
        self.head, self.tail = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        self.head[at] = True
        self.tail[at[1:][at[1:] > 0] - 1] = True
        self.digit = _DIGIT[c]
        self.digits = np.append(0, np.cumsum(self.digit))

    def runs(self, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = T.words(self.c, self.at, solid)
        return w.starts, w.ends

    def between(self, which: np.ndarray, solid: np.ndarray) -> np.ndarray:
        """Those of `which` with a solid character of the same text on either side."""
        n = len(self.c)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        return which & before & after & ~self.head[:n] & ~self.tail[:n]

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """kind, start, end (places in the pass), in order of kind and start."""
        found = [(k, *s) for k, kind in enumerate((self.emails, self.ips, self.cards, self.phones)) for s in kind()]
        out = np.asarray(found, np.int64).reshape(-1, 3)
        return out[:, 0], out[:, 1], out[:, 2]

    def emails(self):
        signs = np.flatnonzero(self.c == 64)
        if not len(signs):
            return
        ls, le = self.runs(_LOCAL[self.c])
        label = _LABEL[self.c]
        dots = self.between(self.c == 46, label)
        ds, de = self.runs(label | dots)
        n_dots = np.append(0, np.cumsum(dots))
        left, right = np.searchsorted(le, signs), np.searchsorted(ds, signs + 1)
        done = 0
        for k, i, j in zip(signs.tolist(), left.tolist(), right.tolist()):
            if self.head[k] or self.tail[k] or i >= len(le) or le[i] != k or j >= len(ds) or ds[j] != k + 1 or n_dots[de[j]] == n_dots[ds[j]]:
                continue
            start = max(int(ls[i]), done)
            if start < k:
                done = int(de[j])
                yield start, done

    def ips(self):
        dots = self.between(self.c == 46, self.digit)
        starts, ends = self.runs(self.digit | dots)
        n = np.append(0, np.cumsum(dots))
        many = n[ends] - n[starts] >= 3
        for s, e in zip(starts[many].tolist(), ends[many].tolist()):
            parts = self.c[s:e].tobytes().split(b".")
            for k in range(0, len(parts) - 3, 4):
                own = parts[k : k + 4]
                size = sum(map(len, own)) + 3
                if all(map(_small, own)):
                    yield s, s + size
                s += size + 1

    def cards(self):
        starts, ends = self.runs(self.digit | self.between((self.c == 32) | (self.c == 45), self.digit))
        n = self.digits[ends] - self.digits[starts]
        fit = (n >= 16) & (n <= 19)
        for s, e in zip(starts[fit].tolist(), ends[fit].tolist()):
            own = self.c[s:e]
            if luhn(own[_DIGIT[own]].tobytes()):
                yield s, e

    def phones(self):
        n = len(self.c)
        after = np.zeros(n, bool)
        after[:-1] = self.digit[1:]
        plus = np.flatnonzero((self.c == 43) & after & ~self.tail[:n])
        if not len(plus):
            return
        _, ends = self.runs(_DIAL[self.c])
        end = ends[np.searchsorted(ends, plus + 1, side="right")]
        last = np.maximum.accumulate(np.where(self.digit, np.arange(n), -1))[end - 1]
        count = self.digits[last + 1] - self.digits[plus]
        fit = (last >= plus + 3) & (count >= 8) & (count <= 15)
        yield from zip(plus[fit].tolist(), (last[fit] + 1).tolist())


# ---- labelled spans ----

_SYLLABLES = "the an er in tion re st le of and ch sch ung ber lich der die und ein que eau ment es la ción os ar ta el de mar lin ro vi no ka son".split() + ["é", "ê", "ç", "ä", "ö", "ü", "ß", "ñ", "ó", "èle", "ître"]
_TOPS = "com org net de fr es io co.uk info eu".split()


def _word(rng) -> str:
    w = "".join(rng.choice(_SYLLABLES, int(rng.integers(1, 5))))
    return w.upper() if rng.random() < 0.06 else w.capitalize() if rng.random() < 0.2 else w


def _plain_word(rng) -> str:
    return "".join(x for x in "".join(rng.choice(_SYLLABLES, int(rng.integers(1, 4)))) if x.isascii())


def _number(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _one(rng, *of) -> str:
    return of[int(rng.integers(len(of)))]


def _email(rng) -> str:
    local = _plain_word(rng) + _one(rng, "", "." + _plain_word(rng), str(rng.integers(100)), "." + str(rng.integers(100)), "_" + _plain_word(rng))
    host = _plain_word(rng) + _one(rng, "", "", str(rng.integers(10)), "-" + _plain_word(rng))
    parts = [host, *([_one(rng, "example", _plain_word(rng))] if rng.random() < 0.3 else []), _one(rng, *_TOPS)]
    at, dot = _one(rng, "@", "@", " @ ", "(at)", " (at) ", "[at]", " [at] ", " at ", " AT "), "."
    if at.strip().lower() == "at" or at != "@" and rng.random() < 0.6:
        dot = _one(rng, " dot ", "[dot]", "(dot)", " [dot] ", " (dot) ", " DOT ")
    return local + at + dot.join(parts)


def _ip(rng) -> str:
    return _one(rng, ".", ".", ".", "[.]", " . ", "(.)", "[dot]").join(str(rng.integers(256)) for _ in range(4))


def _card(rng) -> str:
    sep = _one(rng, "", "", " ", "-", ".", "  ", "/", "_", " - ")
    if rng.random() < 0.15:
        return sep.join((_number(rng, 4), _number(rng, 6), _number(rng, 5)))
    return sep.join(_number(rng, 4) for _ in range(4)) if sep else _number(rng, 16)


def _phone(rng) -> str:
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    local = _one(rng, f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"{a} {b} {c}", f"{a}/{b}-{c}")
    p = _one(rng, "+1 ", "+1-", f"+{rng.integers(20, 99)} ", "1-", "", "", "", "001 ", f"00{rng.integers(20, 99)} ", f"+{rng.integers(20, 99)}/")
    return p + local


def _harmless(rng) -> str:
    n = lambda k: _number(rng, k)
    y, m, d = rng.integers(1950, 2030), rng.integers(1, 13), rng.integers(1, 29)
    k = int(rng.integers(18))
    if k < 2:
        return f"{y}-{m:02d}-{d:02d}" + _one(rng, "", f" {n(2)}:{n(2)}:{n(2)}", f"T{n(2)}:{n(2)}")
    if k == 2:
        return f"{d:02d}.{m:02d}.{y}"
    if k == 3:
        return f"{rng.integers(1, 999)},{n(3)},{n(3)}.{n(2)}"
    if k == 4:
        return f"v{rng.integers(9)}.{rng.integers(30)}.{rng.integers(30)}"
    if k < 8:
        return "".join(rng.choice(list("0123456789abcdef"), int(rng.integers(12, 44))))
    if k < 10:
        return "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"), int(rng.integers(12, 40))))
    if k < 13:
        return n(int(rng.integers(1, 13)))
    if k == 13:
        return f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}"
    if k == 14:
        return f"{_plain_word(rng).upper()}-{n(4)}-{n(4)}"
    if k == 15:
        return f"{y} - {y + 5}, {n(2)} + {n(2)} = {n(3)}"
    if k == 16:
        return _one(rng, "@", "@@ ", " at ", " dot ", "(at) ") + _plain_word(rng)
    return f"{_plain_word(rng)} at {_plain_word(rng)}. {_word(rng)}"


def labelled_spans(n: int = LABELLED, seed: int = 17, length: int = LENGTH) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, [(kind, start, end)]) of n made-up texts of `length` characters: personal data and look-alikes in odd prose."""
    rng, out = np.random.Generator(np.random.PCG64(seed)), []
    makers = (_email, _ip, _card, _phone)
    for _ in range(n):
        text, spans = "", []
        junk, often = _one(rng, "", "", "", "", "###", "!!", "&&&", "%%%"), _one(rng, 0.1, 0.1, 0.3)
        while len(text) < 2 * length:
            p = rng.random()
            if p < often:
                k = int(rng.integers(4))
                x = makers[k](rng)
                spans.append((k, len(text), len(text) + len(x)))
                text += x
            elif p < often + 0.1:
                text += _harmless(rng)
            else:
                text += _word(rng)
            text += junk + _one(rng, " ", " ", " ", " ", ", ", ". ", "\n", '" ', ": ", " or ", " and ")
        inside = [s for s in spans if s[2] - s[1] < length]
        lo = int(rng.integers(0, length))
        if inside and rng.random() < 0.9:
            _, s, e = inside[int(rng.integers(len(inside)))]
            lo = int(np.clip(rng.integers(e - length, s + 1), 0, len(text) - length))
        if not text[lo : lo + length].strip():
            continue
        cut = [(k, max(s, lo) - lo, min(e, lo + length) - lo) for k, s, e in spans if e > lo and s < lo + length]
        out.append((text[lo : lo + length], cut))
    return out


# ---- the model ----

_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SYMBOL = np.full(256, 3, np.int64)  # 0 no character, 1 white space, 2 digit, 3 any other, 4 letters that aren't a to z
_SYMBOL[[9, 10, 11, 12, 13, 32]] = 1
_SYMBOL[48:58] = 2
_SYMBOL[0xC3:0xD0] = 4
for _i, _x in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _SYMBOL[ord(_x)] = _SYMBOL[ord(_x.upper())] = 5 + _i
for _i, _x in enumerate(_PUNCTUATION):
    _SYMBOL[ord(_x)] = 31 + _i
SYMBOLS = 31 + len(_PUNCTUATION)
#: Inside goes on with its own kind only.
_ALLOWED = np.zeros((TAGS, TAGS), np.float32)
for _k in range(len(KINDS)):
    _ALLOWED[:, 2 + 2 * _k] = _NO
    _ALLOWED[1 + 2 * _k : 3 + 2 * _k, 2 + 2 * _k] = 0
_FIRST = np.where(np.arange(TAGS) % 2 == 0, _NO, 0).astype(np.float32)
_FIRST[0] = 0
_sigmoid = lambda x: 0.5 * np.tanh(0.5 * x) + 0.5


def _symbols(texts: list[str], length: int) -> np.ndarray:
    out = np.zeros((len(texts), length), np.int64)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        own = _SYMBOL[raw[(raw & 0xC0) != 0x80]][:length]
        out[i, : len(own)] = own
    return out


@dataclass
class Model:
    """Weights: of each direction symbols, recurrence and bias (gates in, forget, out, new); tags; transitions."""

    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, rng, hidden: int) -> Model:
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.3, (SYMBOLS, 4 * hidden))
            w[f"h{d}"] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden))
            w[f"g{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], hidden)
        w["v"], w["c"], w["t"] = rng.normal(0, 0.2, (2 * hidden, TAGS)), np.zeros(TAGS), np.zeros((TAGS, TAGS))
        return cls({k: x.astype(np.float32) for k, x in w.items()})

    def states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, row, hidden) of symbols (row, time) in one direction."""
        n, steps = x.shape
        h = self.w[f"h{d}"].shape[0]
        out = np.empty((steps, n, h), np.float32)
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        table = self.w[f"x{d}"] + self.w[f"g{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = table[x[:, t]] + state @ self.w[f"h{d}"]
            gate = _sigmoid(z[:, : 3 * h])
            new = np.tanh(z[:, 3 * h :])
            before = cell
            cell = gate[:, h : 2 * h] * cell + gate[:, :h] * new
            squashed = np.tanh(cell)
            if keep is not None:
                keep.append((t, state, before, gate, new, squashed))
            state = gate[:, 2 * h :] * squashed
            out[t] = state
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Tag scores (time, row, tag)."""
        return np.concatenate([self.states(x, "f"), self.states(x, "b")], 2) @ self.w["v"] + self.w["c"]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best path of tags (row, time), and how far its score is above that of `none` at each place."""
        s = self.scores(x)
        steps, n, _ = s.shape
        move = self.w["t"] + _ALLOWED
        best, back = s[0] + _FIRST, np.empty((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            way = best[:, :, None] + move
            back[t] = way.argmax(1)
            best = np.take_along_axis(way, back[t][:, None, :].astype(np.int64), 1)[:, 0] + s[t]
        path = np.empty((n, steps), np.int64)
        path[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            path[:, t - 1] = back[t][np.arange(n), path[:, t]]
        margin = np.take_along_axis(s, path.T[:, :, None], 2)[:, :, 0] - s[:, :, 0]
        return path, margin.T

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood per place of the tags y, and its gradients."""
        n, steps = x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        hs = np.concatenate([self.states(x, d, kept[d]) for d in "fb"], 2)
        s = hs @ self.w["v"] + self.w["c"]
        move = self.w["t"] + _ALLOWED
        total = lambda z, axis: (m := z.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(z - m).sum(axis))
        fore, hind = np.empty_like(s), np.zeros_like(s)
        fore[0] = s[0] + _FIRST
        for t in range(1, steps):
            fore[t] = total(fore[t - 1][:, :, None] + move, 1) + s[t]
        for t in range(steps - 2, -1, -1):
            hind[t] = total(move + (s[t + 1] + hind[t + 1])[:, None, :], 2)
        z = total(fore[-1], 1)
        there = np.exp(fore + hind - z[:, None])
        rows = np.arange(n)
        gold = s[np.arange(steps)[:, None], rows, y.T].sum(0) + self.w["t"][y[:, :-1], y[:, 1:]].sum(1)
        ds = there
        ds[np.arange(steps)[:, None], rows, y.T] -= 1
        ds /= n
        dt = np.zeros_like(move)
        for t in range(1, steps):
            dt += np.exp(fore[t - 1][:, :, None] + move + (s[t] + hind[t])[:, None, :] - z[:, None, None]).sum(0)
        np.subtract.at(dt, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        h = hs.shape[2] // 2
        g = {"t": dt / n, "v": hs.reshape(-1, 2 * h).T @ ds.reshape(-1, TAGS), "c": ds.sum((0, 1))}
        dh = ds @ self.w["v"].T
        for k, d in enumerate("fb"):
            own, u = dh[:, :, k * h : (k + 1) * h], self.w[f"h{d}"]
            gx, gu = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(u)
            state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t, before_h, before_c, gate, new, squashed in reversed(kept[d]):
                state = state + own[t]
                i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
                cell = cell + state * o * (1 - squashed**2)
                dz = np.concatenate([cell * new * i * (1 - i), cell * before_c * f * (1 - f), state * squashed * o * (1 - o), cell * i * (1 - new**2)], 1)
                np.add.at(gx, x[:, t], dz)
                gu += before_h.T @ dz
                state, cell = dz @ u.T, cell * f
            g |= {f"x{d}": gx, f"h{d}": gu, f"g{d}": gx.sum(0)}
        return float((z - gold).mean() / steps), g


_trained: dict[tuple, Model] = {}


def train(labelled: list | None = None, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 17, batch: int = 48, rate: float = 0.04) -> Model:
    """A model of labelled spans (labelled_spans() if none are given), by Adam; made once for a driver and seed."""
    memo = (hidden, epochs, seed, batch, rate)
    if labelled is None and memo in _trained:
        return _trained[memo]
    rows = labelled_spans(seed=seed) if labelled is None else labelled
    length = max(len(t) for t, _ in rows)
    x, y = _symbols([t for t, _ in rows], length), np.zeros((len(rows), length), np.int64)
    for i, (_, spans) in enumerate(rows):
        for k, s, e in spans:
            y[i, s:e] = 2 + 2 * k
            y[i, s] = 1 + 2 * k
    rng = np.random.Generator(np.random.PCG64(seed))
    model = Model.fresh(rng, hidden)
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    v = {k: np.zeros_like(a) for k, a in model.w.items()}
    step, steps = 0, epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), batch):
            own = order[lo : lo + batch]
            _, g = model.gradients(x[own], y[own])
            norm = np.sqrt(sum(float((a**2).sum()) for a in g.values()))
            step += 1
            pace = rate * (1 - 0.95 * step / steps)
            for k, a in g.items():
                a = a * min(1.0, 5.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.999 * v[k] + 0.001 * a * a
                model.w[k] = (model.w[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    if labelled is None:
        _trained[memo] = model
    return model


# ---- whole texts ----

_AT, _DOT = r"(?:@|\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+|\s+@\s+)", r"(?:\.|\s*[\[({]\s*(?:dot|\.)\s*[\])}]\s*|\s+dot\s+)"
_EMAIL = re.compile(rf"[a-z0-9._%+-]+{_AT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)+", re.I)
_IP = re.compile(r"[0-9]{1,3}(?:(?:\s*\.\s*|[\[(](?:\.|dot)[\])])[0-9]{1,3}){3}")
_PHONE = re.compile(r"(?:\+|00)?[\d(](?:[\s().\-/_]{0,3}\d)+")
_CARD = re.compile(r"\d(?:[\s.\-/_]{0,3}\d)+")


def confirmed(kind: int, text: str) -> bool:
    """Whether a text has the parts that its kind must have."""
    digits = "".join(x for x in text if x in "0123456789")
    if kind == 0:
        return bool(_EMAIL.fullmatch(text)) and any(x in text.lower() for x in ("@", "at"))
    if kind == 1:
        return bool(_IP.fullmatch(text)) and all(int(x) <= 255 for x in re.findall(r"\d+", text))
    if kind == 2:
        return 15 <= len(digits) <= 19 and bool(_CARD.fullmatch(text)) and luhn(digits.encode())
    return 10 <= len(digits) <= 15 and bool(_PHONE.fullmatch(text)) and any(not x.isdigit() for x in text)


def parts(kind: int, text: str) -> list[tuple[int, int]]:
    """The confirmed pieces of a span that the model says: all of it, or what of it looks like its kind."""
    if confirmed(kind, text):
        return [(0, len(text))]
    return [m.span() for m in (_EMAIL, _IP, _CARD, _PHONE)[kind].finditer(text) if confirmed(kind, m[0])]


def grid(c: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, text) of every window of the texts of a pass."""
    half = WINDOW // 2
    size = np.diff(at)
    many = np.where(size > 0, np.maximum(-(-(size - half) // half), 1), 0)
    doc = np.repeat(np.arange(len(size)), many)
    return at[:-1][doc] + half * (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)), doc


_EDGE = _flags(bytes([*range(9, 14), *range(28, 33), *range(128, 256)]) + b"()[]{}")


def windows(c: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of grid() in which anything can be confirmed(); what the model says of others would be dropped.

    Each kind but email has four digits at least; an email has an at sign, or `at` between white space or brackets.
    """
    start, doc = grid(c, at)
    low, edge, n = T.LOWER[c], _EDGE[c], len(c)
    sign = low == 64
    if n > 3:
        sign[1:-2] |= (low[1:-2] == 97) & (low[2:-1] == 116) & edge[:-3] & edge[3:]
    digits, signs = np.append(0, np.cumsum(_DIGIT[c])), np.append(0, np.cumsum(sign))
    end = np.minimum(start + WINDOW, at[1:][doc])
    may = (digits[end] - digits[start] >= 4) | (signs[end] > signs[start])
    return start[may], doc[may]


def reconciled(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Of spans (kind, start, end, weight) of all windows of a text those that don't overlap and weigh most together."""
    best: dict[tuple[int, int, int], float] = {}
    for k, s, e, w in spans:
        best[k, s, e] = max(w, best.get((k, s, e), 0.0))
    order = sorted(best, key=lambda x: (x[2], x[1], x[0]))
    ends = np.asarray([x[2] for x in order])
    sums, taken = [0.0], []
    for i, x in enumerate(order):
        before = int(np.searchsorted(ends[:i], x[1], side="right"))
        with_it = sums[before] + best[x]
        taken.append((with_it > sums[i], before))
        sums.append(max(with_it, sums[i]))
    out, i = [], len(order)
    while i:
        use, before = taken[i - 1]
        if use:
            out.append(order[i - 1])
        i = before if use else i - 1
    return out[::-1]


def learned(model: Model, c: np.ndarray, at: np.ndarray, raw: np.ndarray, first: np.ndarray, base: tuple, batch: int = 2048, which=windows) -> list[tuple[int, int, int]]:
    """(kind, start, end) that the model adds to the base spans of a pass. raw: all bytes; first: where each character begins.

    Every window that can hold a confirmed span is decoded (`which`: windows, or grid, with the same result). A span that
    a window's edge cuts is whole in the next window, unless it is longer than half a window: then the windows of twice the
    width that hold its middle are decoded, and so on until one holds the span or the text.
    """
    start, doc = which(c, at)
    taken = np.zeros(len(c) + 1, bool)
    for s, e in zip(base[1].tolist(), base[2].tolist()):
        taken[s:e] = True
    symbol = np.where(taken[:-1], 4, _SYMBOL[c])  # what is found already reads as a foreign word
    said: dict[int, dict] = {}
    width = WINDOW
    while len(start):
        wider = set()
        step = max(1, batch * WINDOW // width)
        for lo in range(0, len(start), step):
            s, d = start[lo : lo + step], doc[lo : lo + step]
            place = s[:, None] + np.arange(width)
            inside = place < at[1:][d][:, None]
            x = np.where(inside, symbol[np.minimum(place, len(c) - 1)], 0)
            path, margin = model.decode(x)
            begin = (path % 2 == 1)
            goes = (path > 0) & ~begin
            over = np.cumsum(margin, 1)
            stop = np.ones_like(goes)
            stop[:, :-1] = ~goes[:, 1:]
            for i, j in zip(*(a.tolist() for a in np.nonzero(begin & inside))):
                e = j + int(stop[i, j:].argmax()) + 1
                at0, at1 = int(at[d[i]]), int(at[d[i] + 1])
                if j == 0 and s[i] > at0 or e == width and s[i] + width < at1:
                    if e - j > width // 2:
                        k = (int(s[i]) + (j + e) // 2 - at0) // width
                        wider |= {(at0 + max(k - 1, 0) * width, int(d[i])), (at0 + k * width, int(d[i]))}
                elif inside[i, e - 1]:
                    weight = float(over[i, e - 1] - (over[i, j - 1] if j else 0))
                    if weight > 0:
                        span = int(path[i, j]) // 2, int(s[i]) + j, int(s[i]) + e
                        own = said.setdefault(int(d[i]), {})
                        own[span] = max(weight, own.get(span, 0.0))
        start, doc = (np.asarray(x, np.int64) for x in zip(*sorted(wider, key=lambda w: (w[1], w[0])))) if wider else (np.zeros(0, np.int64),) * 2
        width *= 2
    out = []
    for spans in said.values():
        good = []
        for (k, s, e), weight in spans.items():  # only what is confirmed competes
            good += [(k, s + i, s + j, weight) for i, j in parts(k, raw[first[s] : first[e]].tobytes().decode()) if not taken[s + i : s + j].any()]
        out += reconciled(good)
    return out


SPANS = "array<struct<kind: string, start: int, end: int, learned: boolean>>"


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, text, spans (kind, start, end in code points, end exclusive, learned; by kind and start) of every row.

    Four fixed patterns give base spans: email, ip (parts up to 255), card (16 to 19 digits by Luhn), phone (8 to 15 digits).
    Then windows of WINDOW characters, one every half window, go through a bidirectional LSTM over characters with CRF
    transitions (base spans read as foreign words there), but for those in which nothing could be confirmed; longer spans get
    wider windows. Of what is decoded stays what has its kind's parts (parts()) and touches no base span, and of that
    the spans of a text that weigh most together without overlap. The model is trained from labelled_spans(),
    LABELLED made-up windows, unless given: no table holds labelled spans.

    Null texts are empty and have no spans; texts of any length are read whole; repeated rows count each; an empty table
    gives no rows; other columns are not read, whatever their names.
    """
    ship(docs.sparkSession)
    model = model or train()
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("learned", pa.bool_())])
    names = np.asarray(KINDS, object)

    def run(batches):
        for rows, data, offsets in passes(batches):
            c, at = characters(data, offsets)
            first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            base = Base(c, at).spans() if len(c) else (np.zeros(0, np.int64),) * 3
            more = np.asarray(learned(model, c, at, data, first, base) if len(c) else [], np.int64).reshape(-1, 3)
            kind, s, e = (np.append(base[i], more[:, i]) for i in range(3))
            new = np.append(np.zeros(len(base[0]), bool), np.ones(len(more), bool))
            doc = np.searchsorted(at[1:], s, side="right")
            by = np.lexsort((s, kind, doc))
            kind, s, e, new, doc = kind[by], s[by], e[by], new[by], doc[by]
            flat = pa.StructArray.from_arrays([pa.array(names[kind], pa.string()), pa.array((s - at[doc]).astype(np.int32)), pa.array((e - at[doc]).astype(np.int32)), pa.array(new)], fields=list(item))
            edge = np.searchsorted(doc, np.arange(len(at)))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), flat)], ["doc_id", "text", "spans"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return own.mapInArrow(frugal(run), f"doc_id long, text string, spans {SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """op11's columns: counts and digest of the base spans, and all spans."""
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: ~x["learned"])
    of = lambda k: F.filter(base, lambda x: x["kind"] == k)
    count = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *count, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def masked(found: DataFrame) -> DataFrame:
    """doc_id, text with every span replaced by its kind in brackets (where kinds overlap, by the one that begins first)."""
    order = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("s"), (-x["end"]).alias("e"), x["kind"].alias("k"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    put = lambda a, x: F.when(x["s"] >= a["at"], F.struct((-x["e"]).alias("at"), F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, x["s"] - a["at"]), F.lit("["), F.upper(x["k"]), F.lit("]")).alias("out"))).otherwise(a)
    text = F.aggregate(order, start, put, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return found.select("doc_id", text.alias("text"))
