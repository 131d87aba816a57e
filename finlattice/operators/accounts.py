"""The chart of accounts: lookups, allowed series, aliases, its text for prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V


def latest(accounts: DataFrame) -> DataFrame:
    """One row per code: the last one loaded, at the place of the first."""
    g = accounts.groupBy("code").agg(F.max_by(F.struct("name", "description"), "pos").alias("a"), F.min("pos").alias("pos"))
    return g.select("code", "a.name", "a.description", "pos")


def of_income_statements(accounts: DataFrame) -> DataFrame:
    return accounts.where(F.substring("code", 1, 1).between("5", "9"))


def by_code(accounts: DataFrame, code: str) -> DataFrame:
    return accounts.where(F.col("code") == code)


def by_series(accounts: DataFrame, series: str) -> DataFrame:
    return accounts.where(X.series_of(F.col("code")) == series)


def by_category(accounts: DataFrame, category: str) -> DataFrame:
    return accounts.where(X.category_of(F.col("code")) == category)


def allowed_series(section: Column) -> Column:
    """First digits of the accounts a section may hold; words of revenue are looked for first, then of costs."""
    s = F.upper(X.strip(section))
    out = None
    for digit, words in V.SECTION_WORDS.items():
        hit = s.rlike("|".join(words))
        out = F.when(hit, F.array(F.lit(digit))) if out is None else out.when(hit, F.array(F.lit(digit)))
    return out.otherwise(F.array(*(F.lit(d) for d in "56789")))


def in_section(accounts: DataFrame, section: str) -> DataFrame:
    """Accounts a section may hold; all of them for a section without a name."""
    return accounts.where(F.array_contains(allowed_series(F.lit(section)), F.substring("code", 1, 1))) if section else accounts


def lookup(accounts: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """The first accounts in order whose `code - name` holds the text."""
    shown = F.concat_ws(" - ", "code", "name")
    return accounts.where(F.lower(shown).contains(text.lower())).orderBy("pos").limit(limit).select("code", shown.alias("shown"))


def code_of(shown: Column) -> Column:
    return F.get(F.split(shown, " - "), F.lit(0))


def aliases(name: Column) -> Column:
    """The name, its words that mean something and its parts between slashes; sorted, each once."""
    filler = lambda w: F.lower(w).isin(V.ALIAS_FILLERS)
    words = F.split(X.strip(F.regexp_replace(F.regexp_replace(name, "[,&]", ""), "/", " ")), r"\s+")
    parts = F.when(name.contains("/"), F.transform(F.split(name, "/"), X.strip)).otherwise(F.array().cast("array<string>"))
    good = F.concat(F.array(name), F.filter(words, lambda w: ~filler(w) & (F.length(w) > 2)), F.filter(parts, lambda p: ~filler(p) & (p != "")))
    return F.array_sort(F.array_distinct(good))


def alias_index(accounts: DataFrame) -> DataFrame:
    """alias (lower case) -> code; the last account loaded has it."""
    a = accounts.select("code", "pos", F.explode(aliases(F.col("name"))).alias("alias"))
    return a.groupBy(F.lower("alias").alias("alias")).agg(F.max_by("code", "pos").alias("code"))


def chart_text(accounts: DataFrame, descriptions: bool = True) -> DataFrame:
    """One row, `text`: a headed block per first digit, accounts by code. The chart is a dimension of some hundred rows."""
    line = F.concat_ws(" - ", "code", "name")
    if descriptions:
        line = F.when(F.coalesce("description", F.lit("")) != "", F.concat(line, F.lit(": "), F.substring("description", 1, 200))).otherwise(line)
    mine = lambda d: F.array_sort(F.collect_list(F.when(F.col("code").startswith(d), F.struct("code", line.alias("line")))))
    blocks = accounts.agg(*(mine(d).alias(f"b{d}") for d in V.CHART_HEADINGS))
    texts = [F.array_join(F.concat(F.array(F.lit(h)), F.col(f"b{d}")["line"]), "\n") for d, h in V.CHART_HEADINGS.items()]
    return blocks.select(F.concat_ws("\n\n", *texts).alias("text"))
