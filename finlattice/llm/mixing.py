"""Mixing sources by temperature, realised as budgeted permutations of blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sharding import number, spotted
from .work import Scratch


def tempered(shares: dict, exponent: float) -> dict:
    """Normalised share ** exponent."""
    top = max(shares.values())
    raw = {s: (x / top) ** exponent for s, x in shares.items()}
    total = sum(raw.values())
    return {s: x / total for s, x in raw.items()}


def entropy(weights: dict) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def bisect(ok, lo: float = 0.0, hi: float = 1.0, rounds: int = 60) -> float:
    """The smallest exponent in [lo, hi] with ok(exponent); ok must hold from some exponent on."""
    if ok(lo):
        return lo
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if ok(mid) else (mid, hi)
    return hi


def exponent_for(tokens: dict, budget: int, max_repeats: float, target_entropy: float | None = None) -> float:
    """1 keeps the sources' own shares, 0 makes them equal.

    As near to equal as `max_repeats` allows (tokens drawn from a source over tokens it has); with a target
    entropy (a share of the most possible), the exponent that meets it, if the limit allows that.
    """
    total = sum(tokens.values())
    shares = {s: n / total for s, n in tokens.items()}
    limit = bisect(lambda a: all(w * budget <= max_repeats * tokens[s] * (1 + 1e-9) for s, w in tempered(shares, a).items()))
    if target_entropy is None:
        return limit
    most = math.log(len(shares)) * target_entropy
    return max(limit, bisect(lambda a: entropy(tempered(shares, a)) <= most))


#: Blocks of a source at most, so that the order of its blocks is one small sort; larger sources have larger blocks.
MAX_BLOCKS = 1 << 16
#: Sources at most: their sums are what the driver gets. More are an error.
MAX_SOURCES = 1 << 16
#: A threshold that every spot meets.
_ALL = (1 << 62) - 1


def turn(*parts: Column) -> Column:
    """A seeded order: a number that follows from the parts."""
    return number(F.concat_ws("|", *(p.cast("string") for p in parts)))


def mix(docs: DataFrame, budget: float = 1.0, max_repeats: float = 2.0, target_entropy: float | None = None, seed: int = 41, block_tokens: int = 1 << 20) -> DataFrame:
    """Rows of `docs` as often as the mixture draws them, with _epoch, _block, _order and _tokens.

    A row's tokens: its words, one at least (null or empty text: 1). The tokens of a source, raised to an exponent
    found by bisection (see exponent_for), give its weight; `budget` times all tokens are shared out by weight. A source
    is dealt to blocks of about `block_tokens` by a seeded hash of what its rows hold (doc_id if there is one, text,
    source); in each epoch its blocks come in a new random order. Whole epochs repeat every row; the last takes
    whole blocks while they fit its budget, and of the next block rows in hash order until the budget is met.
    `_order` is the place of the block in the whole mixture, a seeded number. The driver gets one sum per source
    (MAX_SOURCES at most, else an error). A null source is a source of its own. Repeated rows are rows of their
    own (see spotted; those that tie go together); a long text counts its words like any other; an empty table
    gives no rows. Rows keep all their columns and their names; only the four new names are taken from the
    input, if it has them. No row is joined to itself: copies of a row multiply nothing.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    extra = {"_epoch": "int", "_block": "int", "_order": "long", "_tokens": "long"}
    columns = [c for c in docs.columns if c not in extra]
    # columns by number while rows are dealt: no name of the input's can clash
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    rows = docs.select(*(docs[c].alias(at[c]) for c in columns))
    source = F.coalesce(F.concat(F.lit("s:"), F.col(at["source"]).cast("string")), F.lit("null"))
    rows = spotted(rows, [at[c] for c in ("doc_id", "text", "source") if c in at], seed, scratch).withColumn("src", source)
    words = F.greatest(F.regexp_count(F.coalesce(F.col(at["text"]).cast("string"), F.lit("")), F.lit(r"[^ \t-\r]+")), F.lit(1)).cast("long")
    measured = scratch.keep(rows.select("spot", words.alias("size"), "src"))
    sums = measured.groupBy("src").agg(F.sum("size")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    tokens = dict(sorted(tuple(r) for r in sums))
    if not tokens:
        return docs.select(*(docs[c] for c in columns), *(F.lit(None).cast(t).alias(c) for c, t in extra.items())).limit(0)
    total = int(sum(tokens.values()) * budget)
    weights = tempered({s: n / sum(tokens.values()) for s, n in tokens.items()}, exponent_for(tokens, total, max_repeats, target_entropy))
    plan = [(s, int(weights[s] * total) // n, int(weights[s] * total) % n, min(MAX_BLOCKS, max(1, -(-n // block_tokens)))) for s, n in tokens.items()]
    plan = F.broadcast(spark.createDataFrame(plan, "src string, full long, rest long, blocks int"))  # MAX_SOURCES rows at most
    block = F.pmod(F.col("spot"), F.col("blocks")).cast("int").alias("block")
    placed = measured.join(plan, "src").select("spot", "size", "src", "full", "rest", block)
    # the order of the last epoch's blocks says which of them fit
    sums = placed.groupBy("src", "block", "full", "rest").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("src").orderBy(turn(F.lit(seed), F.col("src"), F.col("full"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1))
    dealt = sums.withColumn("left", F.col("rest") - F.coalesce(before, F.lit(0))).where("left > 0")
    dealt = scratch.keep(dealt.select("src", "block", "n", "left"))
    whole = dealt.where("n <= left").select("src", "block", F.lit(_ALL).alias("upto"))
    # of one block of each source, the rows up to a spot
    head = F.sum("size").over(Window.partitionBy("src", "block").orderBy("spot").rowsBetween(Window.unboundedPreceding, -1))
    part = placed.join(dealt.where("n > left").select("src", "block", "left"), ["src", "block"]).groupBy("src", "block", "left", "spot").agg(F.sum("size").alias("size"))
    part = part.withColumn("head", F.coalesce(head, F.lit(0))).where("head < left").groupBy("src", "block").agg(F.max("spot").alias("upto"))
    taken = scratch.keep(whole.unionByName(part))
    often = rows.join(plan, "src").select("*", block).join(taken, ["src", "block"], "left")
    often = often.withColumn("times", F.col("full") + F.coalesce((F.col("spot") <= F.col("upto")).cast("long"), F.lit(0))).where("times > 0")
    out = often.select("*", F.explode(F.expr("sequence(0, cast(times as int) - 1)")).alias("epoch"))
    order = turn(F.lit(seed), F.col("src"), F.col("epoch"), F.col("block"))
    return out.select(*(F.col(at[c]).alias(c) for c in columns), F.col("epoch").alias("_epoch"), F.col("block").alias("_block"), order.alias("_order"), words.alias("_tokens"))


def digest(mixed: DataFrame) -> DataFrame:
    """What the mixture drew, without texts."""
    return mixed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), F.col("_order").alias("block_order"), F.col("_tokens").alias("n_tokens"))
