"""The stages of the training-data pipeline: five operators, each on all that its predecessor kept.

Every stage but the last takes and returns the columns of documents, in any order and with any others beside them,
which it drops. Null and empty texts pass every filter; repeated rows are rows of their own but for near_duplicates, of
which they are copies; an empty table gives an empty table; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash, mixing, packing, secret_scan, toxicity
from .queries import table, vocabulary
from .sharding import settled
from .work import Scratch, collected

#: The columns that every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the grammar doesn't score as toxic, judged row by row (null or empty text: not toxic)."""
    return toxicity.without_toxic(docs.select(*COLUMNS), docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that with the smallest doc_id, as far as doc_ids are unique.

    Near copies share 0.8 of their five-word shingles; op10's two words would link filled templates as well. Rows
    with a repeated or null doc_id go by their own texts, under a number of their own. Texts without words stay, all.
    """
    scratch = Scratch(spark, "groups")
    docs, ident = settled(docs.select(*COLUMNS), scratch)
    again = scratch.keep(docs.groupBy(F.col("doc_id").alias("twice")).count().where("twice is null or count > 1").select("twice"))
    rows = docs.withColumn("key", F.col("doc_id"))
    if again.limit(1).count():
        # above any doc_id in use, so that of a group of both kinds a unique doc_id stays
        own = F.xxhash64(ident).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
        rows = docs.withColumn("own", own).join(again, F.col("doc_id") == F.col("twice"), "left")
        rows = rows.withColumn("key", F.when(F.col("doc_id").isNull() | F.col("twice").isNotNull(), F.col("own")).otherwise(F.col("doc_id"))).drop("own", "twice")
    kept = minhash.near_duplicates(rows.select(F.col("key").alias("doc_id"), "text"), k=5, percent=80).where("kept").select(F.col("doc_id").alias("key"))
    return rows.join(kept, "key", "left_semi").select(*COLUMNS)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark where they stand; n_chars follows the text."""
    return secret_scan.redact(docs.select(*COLUMNS)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture draws them; a null source is one of its own."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences along the Hilbert curve (null or empty text: the end id alone)."""
    return packing.digest(packing.pack(docs, vocabulary()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written and reread, and dropped when the next one is, with the stage's own scratch tables."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = docs
        with collected() as spent:
            docs = scratch.keep(stage(spark, docs, sf_dir))
            spent()
        if k:
            scratch.drop(before)
    return docs
