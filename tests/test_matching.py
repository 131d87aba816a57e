"""Aliases by an automaton and accounts by rare tokens: the same rows as plain comparison, and bounded candidates."""

import random

from pyspark.sql import functions as F

from finlattice.functions import aliases
from finlattice.functions import text as X
from finlattice.functions import vocabulary as V
from finlattice.operators import matching, statements


def test_aliases_against_plain_containment():
    rng = random.Random(4)
    known = [a for xs in V.METRIC_ALIASES.values() for a in xs]
    labels = ["", "e", "total debt", "net", *known, *(rng.choice(known) + " x" for _ in range(50)), *("".join(rng.choice("netal rvu") for _ in range(rng.randrange(14))) for _ in range(400))]
    machine = aliases.Aliases(known)
    for x in labels:
        assert machine.which(x) == [i for i, a in enumerate(known) if a in x or x in a]


def test_metric_values(spark):
    rng = random.Random(9)
    known = [a for xs in V.METRIC_ALIASES.values() for a in xs]
    rows = [(f"c{i % 7}", rng.randrange(3), i, rng.choice([f"  {rng.choice(known).title()} ", rng.choice(known)[:4], "other", None, ""]), rng.choice(["1", "(2)", "", None, "x"])) for i in range(300)]
    df = spark.createDataFrame(rows, "company string, section_pos int, row_pos int, label string, value_raw string")
    want = {}
    for c, sp, rp, label, raw in rows:
        if label is None or not raw:
            continue
        for m, xs in V.METRIC_ALIASES.items():
            for k, a in enumerate(xs):
                if a in label.strip().lower() or label.strip().lower() in a:
                    want[c, m] = min(want.get((c, m), ((9, 0, 0), "")), ((sp, rp, k), raw))
    out = statements.metric_values(df, "company")
    assert {(r.company, r.metric): r.value for r in out.collect()} == {k: {"1": 1.0, "(2)": -2.0, "x": None}[v[1]] for k, v in want.items()}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def chart(spark, n):
    """Accounts, a third of which hold the word payable; some are named alike."""
    rng = random.Random(2)
    words = "vaccine surgery dental boarding grooming insurance marketing laundry software training travel cleaning".split()
    names = [f"{rng.choice(words)} {rng.choice(words)}" + (" payable" if i % 3 == 0 else f" x{i % 40}") for i in range(n)]
    return spark.createDataFrame([(str(i), x.title(), None, i) for i, x in enumerate(names)], "code string, name string, description string, pos int")


LABELS = ["Payable", "Vaccine payable", "Surgery payable x7", "dental", "Laundry Software Payable", "Payables", "Travel x3", "nothing", "Insur", "Marketing cleaning x12", "boarding boarding payable", "Vaccine surgery", "Training"]


def test_common_tokens_give_the_same_answers(spark):
    a = chart(spark, 400)
    l = spark.createDataFrame([(x,) for x in LABELS], "label string")
    rows = lambda d: sorted(map(str, d.collect()))
    few, every, fewest = (rows(matching.match(l, a, common=n)) for n in (matching.COMMON, 10**9, 3))
    assert few == every == fewest and any("ambiguous" in r for r in few) and any("'token'" in r for r in few)


def test_a_word_in_a_third_of_all_accounts_meets_few(spark):
    counts = []
    for n in (600, 2400):
        a = chart(spark, n).select("pos", F.lower("name").alias("name"), X.tokenize(F.col("name")).alias("atokens"))
        l = spark.createDataFrame([(x,) for x in LABELS], "label string").withColumn("lo", F.lower("label")).withColumn("tokens", X.tokenize(F.col("label")))
        counts.append(matching._token_pairs(l, a, matching.COMMON).distinct().count())
        every = matching._token_pairs(l, a, 10**9).distinct().count()
        assert every > n
    assert counts[1] < counts[0] * 1.6 and counts[1] < every / 4
