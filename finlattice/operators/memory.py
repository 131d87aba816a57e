"""Correction memory: overriding, upserting, promoting and checking rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def override(default: DataFrame, practice: DataFrame) -> DataFrame:
    """Practice rules win over default ones of the same label and section (letter case aside)."""
    both = default.withColumn("p", F.lit(0)).unionByName(practice.withColumn("p", F.lit(1)))
    key = [F.lower("label").alias("label_key"), F.lower("section").alias("section_key")]
    return both.groupBy(*key).agg(F.max_by("correct_code", F.struct("p", "seq")).alias("correct_code"))


def effective(default: DataFrame, practice: DataFrame) -> DataFrame:
    """Whole rules: a practice's own before default ones of the same label and section (letter case aside)."""
    both = default.withColumn("p", F.lit(0)).unionByName(practice.withColumn("p", F.lit(1)))
    g = both.groupBy(F.lower("label").alias("label_key"), F.lower("section").alias("section_key")).agg(F.max_by(F.struct(*both.columns), F.struct("p", "seq")).alias("r"))
    return g.select("r.*").drop("p")


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Known keys: count grows, the correct code is the newest, the wrong code stays. Others are inserted."""
    n = new.groupBy("label", "section").agg(F.count("*").alias("n"), F.max_by("correct_code", "seq").alias("new_code"), F.min_by("wrong_code", "seq").alias("new_wrong"))
    j = existing.join(n, ["label", "section"], "full_outer")
    return j.select("label", "section", F.coalesce("wrong_code", "new_wrong").alias("wrong_code"), F.coalesce("new_code", "correct_code").alias("correct_code"), (F.coalesce("count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("count"), F.col("count").isNull().alias("inserted"))


def promotable(rules: DataFrame, practices: int = 3, count: int = 3) -> DataFrame:
    """Rules that enough practices hold often enough."""
    g = rules.groupBy("label", "section", "correct_code").agg(F.countDistinct("practice_id").alias("practices"), F.sum("count").alias("total"))
    return g.where((F.col("practices") >= practices) & (F.col("total") >= count))


def ignored(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows that hold a code which a rule calls wrong; hard_fail if the rule counts twice or more."""
    r = rules.where("wrong_code <> correct_code").select(F.lower("label").alias("k"), "wrong_code", "correct_code", "count")
    j = rows.join(r, (F.lower("label") == F.col("k")) & (F.col("code") == F.col("wrong_code")))
    return j.select("row_id", "label", "code", "correct_code", (F.col("count") >= 2).alias("hard_fail"))


def prompt_lines(rules: DataFrame, key: str) -> DataFrame:
    """One text per practice, a line per rule in order of seq; rules seen twice or more forbid the wrong code."""
    tail = F.when(F.col("count") >= 2, F.format_string("(NEVER %s)", "wrong_code")).otherwise(F.format_string("(previously mis-mapped to %s)", "wrong_code"))
    line = F.concat(F.format_string('- "%s" in "%s" → %s %s ', "label", "section", "correct_code", "correct_name"), tail)
    g = rules.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("r"))
    return g.select(key, F.array_join("r.line", "\n").alias("prompt"))


def upsert_practices(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rules of practices with corrections added, each counting one: practice, label and section (letter case aside) name a rule.

    A known rule keeps its spelling, wrong code and place and takes the newest correct code and name; others follow in
    the order of their first correction.
    """
    w = Window.partitionBy("practice_id")  # a practice's rules are few
    both = existing.withColumn("fresh", F.lit(0)).unionByName(new.withColumns({"count": F.lit(1).cast("long"), "fresh": F.lit(1)}))
    both = both.withColumn("place", F.when(F.col("fresh") == 0, F.col("seq")).otherwise(F.coalesce(F.max(F.when(F.col("fresh") == 0, F.col("seq"))).over(w), F.lit(-1)) + 1 + F.col("seq")))
    at = F.struct("fresh", "place")
    g = both.groupBy("practice_id", F.lower("label").alias("label_key"), F.lower(F.coalesce("section", F.lit(""))).alias("section_key"))
    first, last = [F.min_by(c, at).alias(c) for c in ("label", "section", "wrong_code")], [F.max_by(c, at).alias(c) for c in ("correct_code", "correct_name")]
    return g.agg(*first, *last, F.sum("count").cast("long").alias("count"), F.min("place").cast("long").alias("seq")).drop("label_key", "section_key")
