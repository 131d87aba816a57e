"""Labels against a chart of accounts: exact, substring and token layers; categorised rows; retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import accounts as A


def _grams(text: Column) -> Column:
    """The distinct pieces of five characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 4, F.lit(1))), lambda i: F.substring(text, i, F.lit(5))))


#: A token that more accounts hold is common: it meets labels by kinds of accounts, not by each of them.
COMMON = 64
#: Accounts that an answer names at most: the best and two more.
NAMED = 3


def _rarest(pieces: DataFrame, key: str) -> DataFrame:
    """Of each `key` its piece that fewest names hold; none if a piece is in no name."""
    g = pieces.groupBy(key).agg(F.min_by("piece", F.struct("names", "piece")).alias("piece"), F.min("names").alias("names"))
    return g.where("names > 0").select(key, "piece")


def _inside(l: DataFrame, a: DataFrame) -> DataFrame:
    """label, pos where one may hold the other (five letters at least): all pieces of the inner are in the outer, so its rarest is enough."""
    grams = a.select("pos", F.explode(_grams(F.col("name"))).alias("piece"))
    held = grams.groupBy("piece").agg(F.count("*").alias("names"))
    name = _rarest(grams.where(F.length("piece") == 5).join(held, "piece"), "pos")
    pieces = l.where(F.length("lo") > 4).select("label", F.explode(_grams(F.col("lo"))).alias("piece"))
    label = _rarest(pieces.join(held, "piece", "left").na.fill(0, ["names"]), "label")
    return pieces.join(name, "piece").select("label", "pos").unionByName(label.join(grams, "piece").select("label", "pos"))


def _token_pairs(l: DataFrame, a: DataFrame, common: int) -> DataFrame:
    """label, pos where tokens may meet: equal or of the same first five letters.

    Rare ones meet one by one. Accounts of the same common tokens are one kind, of which the first NAMED speak: an
    answer names no more, and the others of a kind match no better than they unless a rare token says so.
    """
    head = lambda c: F.substring(c, 1, 5)
    heads = lambda c: F.array_distinct(F.transform(c, head))
    lk, ak = l.select("label", F.explode(heads("tokens")).alias("key")), a.select("pos", "atokens", F.explode(heads("atokens")).alias("key"))
    often = ak.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > common).select("key")
    rare = lk.join(ak.join(often, "key", "left_anti").select("key", "pos"), "key").select("label", "pos")
    shared = ak.join(often, "key").groupBy("pos").agg(F.first("atokens").alias("atokens"), F.collect_set("key").alias("keys"))  # an account's tokens are few
    kind = shared.select("pos", "keys", F.array_sort(F.filter("atokens", lambda t: F.array_contains(F.col("keys"), head(t)))).alias("kind"))
    first = kind.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("pos"))).where(F.col("n") <= NAMED)
    met = lk.join(first.select("pos", F.explode("keys").alias("key")), "key").select("label", "pos")
    return rare.unionByName(met)


def _pairs(labels: DataFrame, accounts: DataFrame, common: int) -> DataFrame:
    """label, pos of the pairs that may match: equal names, one inside the other by its rarest piece, tokens by rarity."""
    l, a = labels.select("label", "lo", "tokens"), accounts.select("pos", "name", "atokens")
    equal = l.select("label", F.col("lo").alias("name")).join(a.select("pos", "name"), "name").select("label", "pos")
    return equal.unionByName(_inside(l, a)).unionByName(_token_pairs(l, a, common)).distinct()


def match(labels: DataFrame, accounts: DataFrame, allow_balance_sheet: bool = True, common: int = COMMON) -> DataFrame:
    """label -> code, confidence, match_type, match_ratio, matched_on, unmatched, alternatives (two at most, if ambiguous).

    accounts: code, name, pos (order of loading). Headers and compounds are told first; then the first account in
    order that is equal, contains the label (over 4 letters) or is contained in it; then shares of tokens, the
    best first, earlier accounts first among equals. Unless `allow_balance_sheet`, only accounts of income statements count.
    Tokens that over `common` accounts hold are looked up by kind of account; it changes no answer.
    """
    if not allow_balance_sheet:
        accounts = A.of_income_statements(accounts)
    l = labels.select("label").distinct().withColumn("lo", F.lower(X.strip(F.col("label")))).withColumn("tokens", X.tokenize(F.col("label")))
    l = l.withColumn("header", X.is_section_header(F.col("label"))).withColumn("compound", X.is_compound(F.col("label")))
    a = accounts.select("code", "pos", F.lower("name").alias("name"), X.tokenize(F.col("name")).alias("atokens"))
    plain = l.where("not header and not compound")
    layer1 = F.when(F.col("lo") == F.col("name"), 1).when((F.length("lo") > 4) & F.col("name").contains(F.col("lo")), 2).when((F.length("name") > 4) & F.col("lo").contains(F.col("name")), 3)
    met = F.exists("tokens", lambda p: F.exists("atokens", lambda c: (p == c) | ((F.length(p) >= 5) & (F.length(c) >= 5) & (p.startswith(c) | c.startswith(p)))))
    hit = plain.join(_pairs(plain, a, common), "label").join(a, "pos").where(layer1.isNotNull() | met)
    ratio = F.when(F.size("tokens") > 0, F.size(X.overlap(F.col("tokens"), F.col("atokens"))) / F.size("tokens")).otherwise(0.0)
    hit = hit.withColumn("layer", F.coalesce(layer1, F.lit(4))).withColumn("ratio", ratio)
    w = Window.partitionBy("label").orderBy((F.col("layer") == 4).cast("int"), F.when(F.col("layer") < 4, F.lit(0.0)).otherwise(-F.col("ratio")), "pos")
    n = F.count(F.when(F.col("ratio") > 0, 1)).over(Window.partitionBy("label"))
    ranked = hit.withColumn("n", n).withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    best = ranked.where("rn = 1").select("label", "code", "layer", "ratio", "n", X.overlap(F.col("tokens"), F.col("atokens")).alias("met"), F.col("name").alias("account"))
    others = ranked.where("rn > 1 and layer = 4").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rn", "code")))["code"].alias("next_codes"))
    out = l.join(best, "label", "left").join(others, "label", "left")
    kind = F.when(F.col("header"), "header").when(F.col("compound"), "compound").when(F.col("layer").isNull(), "unmatched")
    kind = kind.when(F.col("layer") == 1, "exact").when(F.col("layer") < 4, "exact_substring").when(F.col("ratio") == 1, "token").otherwise("token_partial")
    sure = F.when(F.col("header"), "high").when(F.col("compound"), "compound").when(F.col("layer").isNull(), "unmatched").when(F.col("layer") <= 2, "high").when(F.col("layer") == 3, "medium")
    sure = sure.when(F.col("ratio") == 1, F.when(F.col("n") == 1, "high").otherwise("ambiguous")).otherwise("medium")
    on = F.when(F.col("layer") <= 2, F.array("label")).when(F.col("layer") == 3, F.array("account")).otherwise(F.array_sort("met"))
    return out.select("label", "code", sure.alias("confidence"), kind.alias("match_type"), F.round(F.when(F.col("layer") == 4, F.col("ratio")), 6).alias("match_ratio"), on.alias("matched_on"), F.array_except("tokens", F.coalesce("met", F.array().cast("array<string>"))).alias("unmatched"), F.when(sure == "ambiguous", F.col("next_codes")).alias("alternatives"))


def compound_candidates(labels: DataFrame, accounts: DataFrame) -> DataFrame:
    """label, part, code: the account of each part of a compound label that has one, in order of part_pos."""
    parts = labels.select("label").distinct().where(X.is_compound(F.col("label"))).select("label", F.posexplode(X.compound_parts(F.col("label"))).alias("part_pos", "part"))
    found = match(parts.select(F.col("part").alias("label")), accounts).where("code is not null").select(F.col("label").alias("part"), "code")
    return parts.join(found, "part").select("label", "part_pos", "part", "code")


def summary(results: DataFrame) -> DataFrame:
    """Counts by confidence and match_type."""
    return results.groupBy("confidence", "match_type").agg(F.count("*").alias("n"))


def totals(results: DataFrame) -> DataFrame:
    """One row: total, auto (of high confidence), review (the others), match_rate, and counts by_confidence and by_match_type."""
    by = {c: results.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}")) for c in ("confidence", "match_type")}
    high = F.count_if(F.col("confidence") == "high")
    whole = results.agg(F.count("*").alias("total"), high.alias("auto"), (F.count("*") - high).alias("review"), F.coalesce(F.try_divide(high, F.count("*")), F.lit(0.0)).alias("match_rate"))
    return whole.crossJoin(by["confidence"]).crossJoin(by["match_type"])  # one row each


def retry_merge(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that need review take the newest result for their label, if there is one."""
    last = new.groupBy("label").agg(F.max_by("code", "seq").alias("new_code"))
    out = rows.join(last, "label", "left")
    use = F.col("needs_review") & F.col("new_code").isNotNull()
    return out.withColumn("match_type", F.when(use, "llm_retry").otherwise(F.col("match_type"))).withColumn("code", F.when(use, F.col("new_code")).otherwise(F.col("code"))).drop("new_code")


def search(accounts: DataFrame, text: str) -> DataFrame:
    """Accounts whose name is `text` (the last loaded first), then those whose name or description holds it, in order."""
    q = text.lower()
    name = F.lower("name")
    hit = accounts.where(name.contains(q) | F.lower(F.coalesce("description", F.lit(""))).contains(q))
    same = F.max(F.when(name == q, F.col("pos"))).over(Window.partitionBy(F.lit(1)))  # the chart is a small dimension
    order = F.row_number().over(Window.orderBy((~F.coalesce(F.col("pos") == F.col("same"), F.lit(False))).cast("int"), "pos"))
    return hit.withColumn("same", same).select("code", "name", order.alias("place"))
