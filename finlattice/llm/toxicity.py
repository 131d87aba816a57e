"""Toxicity by a weighted finite-state grammar over clauses; its insult lexicon and weights come from labels."""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T
from .work import Scratch, frugal, passes, slices, text_of, utf8

#: Function words of the grammar in English, German, French and Spanish.
TARGETS = "you your yours u he she they them du dich dir ihr euch sie tu toi te vous il elle ils tú usted ustedes vosotros él ella".split()
NEGATIONS = "not no never isn't aren't nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say called calls quoted wrote writes told sagte sagt nannte schrieb dit disait écrit appelle dijo dice llamó escribió".split()
THREATS = (
    "kill kills killed killing hurt hurts hurting destroy destroys destroyed destroying beat beats beating murder murders murdered murdering "
    "shoot shoots shooting stab stabs stabbed stabbing töten töte tötet umbringen verletzen verletze verletzt schlagen schlage schlägt "
    "tuer tue tuerai frapper frappe détruire détruis matar mato mataré golpear golpeo destruir destruyo"
).split()

#: Symbols of a clause: other, insult, threat verb, target, negation, report.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Symbols that the grammar adds: reported, negated and targeted insult, threat at a target, reported threat, target of an insult before it.
REPORTED, NEGATED, TARGETED, MENACE, RETOLD, AIMED = range(6, 12)
SYMBOLS = 12
#: Outputs that count, in the order of the features.
SCORED = (INSULT, TARGETED, NEGATED, REPORTED, MENACE, RETOLD, AIMED)
#: Words over which a negation, a target or a threat reaches.
NEGATION_REACH, TARGET_REACH, THREAT_REACH = 3, 4, 4

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = _LETTER[39] = True
_BREAK = np.zeros(256, bool)
_BREAK[np.frombuffer(b".!?;:\n|", np.uint8)] = True
#: Bytes of the word stems that the lexicon may hold beside whole words.
STEMS = (4, 5, 6)


class Transducer:
    """Deterministic: step(state, symbol) gives the next state and the symbol written."""

    def __init__(self, start: Hashable, step: Callable):
        self.start, self.step = start, step

    def __rshift__(self, other: Transducer) -> Transducer:
        """Composition: what self writes, other reads."""

        def step(state, symbol):
            a, middle = self.step(state[0], symbol)
            b, out = other.step(state[1], middle)
            return (a, b), out

        return Transducer((self.start, other.start), step)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All reachable states by number: next[state][symbol], written[state][symbol]."""
        number, todo, rows = {self.start: 0}, [self.start], []
        for state in todo:
            row = []
            for symbol in range(SYMBOLS):
                to, out = self.step(state, symbol)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append((number[to], out))
            rows.append(row)
        return np.asarray([[x for x, _ in r] for r in rows]), np.asarray([[y for _, y in r] for r in rows])


def _reported(state, symbol):
    if symbol == REPORT:
        return 1, symbol
    return state, {INSULT: REPORTED, THREAT: RETOLD}.get(symbol, symbol) if state else symbol


def _negated(state, symbol):
    if symbol == NEGATION:
        return NEGATION_REACH, symbol
    return max(0, state - 1), NEGATED if symbol == INSULT and state else symbol


def _targeted(state, symbol):
    """An insult after a target is targeted; a target after an insult that isn't makes it so."""
    near, insulted = state
    if symbol == TARGET:
        return (TARGET_REACH, 0), AIMED if insulted else symbol
    if symbol == INSULT:
        return (max(0, near - 1), 0 if near else TARGET_REACH), TARGETED if near else symbol
    return (max(0, near - 1), max(0, insulted - 1)), symbol


def _menaced(state, symbol):
    if symbol == THREAT:
        return THREAT_REACH, symbol
    if symbol == TARGET and state:
        return 0, MENACE
    return max(0, state - 1), symbol


def grammar() -> Transducer:
    """Report, negation, target and threat transducers in a cascade; a new clause starts anew."""
    return Transducer(0, _reported) >> Transducer(0, _negated) >> Transducer(0, _menaced) >> Transducer((0, 0), _targeted)


class Reader:
    """Lower-case words of the texts in one pass, their hashes and those of their stems, and clauses."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = w = T.words(data, offsets, _LETTER[data])
        roll = w.roller()
        self.whole = roll.ranges(w.starts, w.ends)
        size = w.ends - w.starts
        self.stems = []
        for k in STEMS:
            h = np.zeros(len(size), np.uint64)
            long = size > k
            h[long] = roll.ranges(w.starts[long], w.starts[long] + k) ^ np.uint64(k)
            self.stems.append(h)
        breaks = np.append(0, np.cumsum(_BREAK[data]))
        self.clause = breaks[w.starts] if len(w.starts) else np.zeros(0, np.int64)


def lower(batches):
    for b in batches:
        at = b.schema.get_field_index("text")
        yield b.set_column(at, "text", pc.utf8_lower(b.column(at)))


def hashed(words: list[str]) -> np.ndarray:
    data = np.frombuffer("\n".join(words).encode(), np.uint8)
    return np.sort(Reader(data, np.asarray([0, len(data)])).whole)


def member(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted keys, -1 if it isn't one."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


def grammar_features(data: np.ndarray, offsets: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray], closed: list, tables: tuple) -> np.ndarray:
    """Per text, the lexicon weight written under each scored symbol (threats and targets weigh 1)."""
    keys, weights = lexicon
    r = Reader(data, offsets)
    w = r.words
    out = np.zeros((len(offsets) - 1, len(SCORED)))
    weight = np.zeros(len(r.whole))
    for h in (r.whole, *r.stems):
        at = member(h, keys)
        hit = at >= 0
        weight[hit] = np.maximum(weight[hit], weights[at[hit]])
    symbol = np.zeros(len(weight), np.int64)
    for s, own in closed:
        symbol[member(r.whole, own) >= 0] = s
    symbol[weight > 0] = INSULT
    start = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
    if not len(start):
        return out
    part = r.clause * np.int64(len(offsets)) + w.doc  # clauses of one text
    new = np.ones(len(part), bool)
    new[1:] = part[1:] != part[:-1]
    begin = np.flatnonzero(new)
    clause = np.unique(np.cumsum(new)[start] - 1)
    ends = np.append(begin[1:], len(part))
    follow, written = tables
    place = {s: i for i, s in enumerate(SCORED)}
    for c in clause.tolist():
        state, lo = 0, int(begin[c])
        for i, s in enumerate(symbol[lo : ends[c]].tolist(), lo):
            o = int(written[state, s])
            state = int(follow[state, s])
            if o in place:
                out[w.doc[i], place[o]] += weight[i] or 1.0
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


#: What each scored symbol counts before any label is seen: a targeted insult most, a target after an insult least.
PRIOR = np.asarray([3.0, 3.6, 1.5, 1.5, 2.4, 0.9, 0.6])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 3000, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression with weights of 0 at least, drawn to PRIOR, by projected gradient steps."""
    w, b = PRIOR.copy(), -4.0
    if not len(y):
        return w, b
    step = 4 / (1 + (x**2).sum(1).mean())
    for _ in range(rounds):
        p = sigmoid(x @ w + b) - y
        w = np.maximum(0, w - step * (x.T @ p / len(y) + ridge * (w - PRIOR)))
        b -= step * 4 * p.mean()
    return w, b


def covering(text: np.ndarray, term: np.ndarray, negatives: np.ndarray, neg: int, least: float) -> np.ndarray:
    """Terms, one after another, that tell most of the toxic texts which no earlier term has told.

    text, term: which terms each toxic text holds, one pair each. So words that only come along with an insult, as in
    copies of one toxic text, aren't taken for one. A text's pairs are counted out once, when it is told.
    """
    by_text = np.argsort(text, kind="stable")
    of_text, edge = term[by_text], np.append(0, np.cumsum(np.bincount(text, minlength=1)))
    by_term = np.argsort(term, kind="stable")
    of_term, start = text[by_term], np.append(0, np.cumsum(np.bincount(term, minlength=len(negatives))))
    open_ = np.diff(edge) > 0
    left = np.bincount(term, minlength=len(negatives)).astype(float)
    chosen: list[int] = []
    while len(negatives):
        rest, n = max(1, int(open_.sum())), left + negatives
        base = rest / (rest + neg)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(left > 0, left * np.log(left / (n * base)), 0) + np.where(negatives > 0, negatives * np.log(negatives / (n * (1 - base))), 0)
        gain[(left / n.clip(1) < 0.5) | (left < 3)] = 0
        if gain.max() <= least:
            break
        best = int(gain.argmax())
        chosen.append(best)
        told = of_term[start[best] : start[best + 1]]
        told = told[open_[told]]
        open_[told] = False
        left -= np.bincount(np.concatenate([of_text[edge[i] : edge[i + 1]] for i in told.tolist()]), minlength=len(negatives))
    return np.sort(np.asarray(chosen, np.int64))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int, scratch: Scratch) -> dict:
    """Lexicon and weights, from at most `max_labelled` labelled rows of the learning folds, taken by hash."""
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    sample = scratch.keep(text.join(F.broadcast(rows), "doc_id").select("text", "toxic"))  # max_labelled pairs of numbers at most
    count = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = count.get(1, 0), count.get(0, 0)
    if not pos or not neg:
        return {"lexicon": (np.zeros(0, np.uint64), np.zeros(0)), "weights": np.zeros(len(SCORED)), "bias": math.log((pos + 0.5) / (neg + 0.5))}

    def terms(batches):
        """Texts of either label that hold a word or stem, by task."""
        for rows, data, offsets in passes(lower(batches)):
            r = Reader(data, offsets)
            toxic = rows.column("toxic").to_numpy()
            h = np.concatenate([r.whole, *r.stems])
            doc = np.tile(r.words.doc, 1 + len(STEMS))
            h, doc = h[h > 0], doc[h > 0]
            by = np.lexsort((doc, h))
            h, doc = h[by], doc[by]
            one = np.ones(len(h), bool)
            one[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[one], doc[one]
            keys, back = np.unique(h, return_inverse=True)
            p = np.bincount(back, weights=toxic[doc] == 1, minlength=len(keys)).astype(np.int64)
            n = np.bincount(back, minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(p), pa.array(n - p)], ["term", "pos", "neg"])

    terms_ = scratch.keep(sample.mapInArrow(frugal(terms), "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    tried = max(2, terms_.where("pos + neg > 1").count())
    base = pos / (pos + neg)
    # twice the log likelihood ratio against chance; so strong that not one of all terms tried would get there by luck
    gain = F.expr(f"pos * ln(pos / ((pos + neg) * {base!r}D)) + if(neg > 0, neg * ln(neg / ((pos + neg) * {1 - base!r}D)), 0D)")
    strong = terms_.where("pos > 0").withColumn("gain", gain).where((F.col("gain") > math.log(tried) + 1) & F.expr(f"pos / {pos}D > 4 * neg / {neg}D and pos > neg"))
    # each strong term is in some ten toxic texts of the sample at least, so the sample bounds their number
    got = np.stack([c.to_numpy() for c in strong.select("term", "pos", "neg").toArrow().itercolumns()], 1).astype(np.int64)
    by = np.argsort(got[:, 0].view(np.uint64))
    got = got[by]
    keys = got[:, 0].copy().view(np.uint64)

    def held(batches):
        """Which of the strong terms each toxic text of the sample holds, one pair of numbers each."""
        done = TaskContext.get().partitionId() << 32
        for rows, data, offsets in passes(lower(batches)):
            r = Reader(data, offsets)
            at, doc = member(np.concatenate([r.whole, *r.stems]), keys), np.tile(r.words.doc, 1 + len(STEMS))
            pair = np.unique(doc[at >= 0].astype(np.int64) * len(keys) + at[at >= 0])
            yield pa.RecordBatch.from_arrays([pa.array(done + pair // len(keys)), pa.array((pair % len(keys)).astype(np.int32))], ["text", "term"])
            done += rows.num_rows

    # of max_labelled texts at most, and of them the strong terms only
    pairs = sample.where("toxic = 1").mapInArrow(frugal(held), "text long, term int").toArrow() if len(keys) else pa.table({"text": pa.array([], pa.int64()), "term": pa.array([], pa.int32())})
    _, number = np.unique(pairs["text"].to_numpy(), return_inverse=True)
    chosen = covering(number, pairs["term"].to_numpy().astype(np.int64), got[:, 2], neg, math.log(tried) + 1)
    weights = np.log((got[chosen, 1] + 0.5) / (pos + 1)) - np.log((got[chosen, 2] + 0.5) / (neg + 1))
    lexicon = (keys[chosen], weights)
    feature = _features(lexicon)

    def measured(batches):
        for rows, data, offsets in passes(lower(batches)):
            x = feature(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column("toxic"), *(pa.array(x[:, i]) for i in range(x.shape[1]))], ["toxic", *(f"x{i}" for i in range(x.shape[1]))])

    rows = sample.mapInArrow(frugal(measured), "toxic int, " + ", ".join(f"x{i} double" for i in range(len(SCORED)))).collect()
    rows.sort()
    m = np.asarray([tuple(r) for r in rows], float)
    weights, bias = fit(np.log1p(m[:, 1:]), m[:, 0])
    return {"lexicon": lexicon, "weights": weights, "bias": bias}


def _features(lexicon):
    closed = [(s, hashed(v)) for s, v in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS))]
    tables = grammar().table()
    return lambda data, offsets: grammar_features(data, offsets, lexicon, closed, tables)


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from its whole text.

    Words and word stems that toxic labelled texts hold far more often than chance make the insult lexicon (log
    odds as weights). Transducers for reported speech, negation, threats and targets (before an insult or after it),
    composed, rewrite each clause; the weights written under each outcome are joined by logistic regression with
    weights of 0 at least. Learning uses at most `max_labelled` labelled rows whose crc32(doc_id) mod 3 is not 1, a
    bounded sample by hash; scores use the text alone. The lexicon is chosen among all terms that strong, however
    many: the sample bounds them, as each is in several of its toxic texts. Null or empty text: the score without any match. Null id: held_out is
    false. Rows are scored one by one, repeated rows too, a long text whole, without a shuffle; labels without
    documents are ignored; of several labels the highest counts; without labels of both kinds every score is the
    share of toxic ones. Other columns are not read, whatever their names; an empty table gives no rows.
    """
    return scored(docs, docs, labels, max_labelled, threshold)


def scored(docs: DataFrame, learn_from: DataFrame, labels: DataFrame, max_labelled: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """As toxicity(), for the rows of `docs`, with a model learned from those of `learn_from`."""
    judge = judged_by(train(learn_from, labels, max_labelled, Scratch(docs.sparkSession, "toxicity")))

    def run(batches):
        for batch in batches:
            for lo, hi, score in judge(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score)], ["doc_id", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(frugal(run), "doc_id long, score double")
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, learn_from: DataFrame, labels: DataFrame, max_labelled: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` that score less than `threshold`, with all their columns; no shuffle, no join."""
    judge = judged_by(train(learn_from, labels, max_labelled, Scratch(docs.sparkSession, "toxicity")))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for lo, hi, score in judge(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(score < threshold))

    return docs.mapInArrow(frugal(run), docs.schema)


def judged_by(model: dict) -> Callable:
    """Row ranges of a text column and the scores of their texts, in passes of bounded size."""
    feature, weights, bias = _features(model["lexicon"]), model["weights"], model["bias"]

    def judge(text: pa.Array):
        data, offsets = utf8(pc.utf8_lower(text))
        for lo, hi in slices(offsets):
            yield lo, hi, sigmoid(np.log1p(feature(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])) @ weights + bias)

    return judge
