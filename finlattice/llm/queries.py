"""One query per operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, lm, minhash, mixing, oracles, packing, pii, quality, secret_scan, sharding, spelling, substring, topk, toxicity

SHARDS = 24


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark, sf_dir):
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op2_sharding(spark, sf_dir):
    return sharding.digest(sharding.shuffled(table(spark, sf_dir, "documents"), SHARDS))


def op3_hilbert_packing(spark, sf_dir):
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), vocabulary()))


def op4_substring_dedup(spark, sf_dir):
    return substring.digest(substring.deduplicated(table(spark, sf_dir, "documents")))


def op5_quality_rules(spark, sf_dir):
    q = quality.quality_rules(table(spark, sf_dir, "documents"))
    return q.withColumn("long_repeat", F.col("longest_repeat") > quality.MAX_LONGEST).drop("longest_repeat")


def op6_lm_scores(spark, sf_dir):
    s = lm.backoff_scores(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_words", *(F.round(c, 6).alias(c) for c in ("log10_sum", "log10_mean")))


def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark, sf_dir):
    return mixing.digest(mixing.mix(table(spark, sf_dir, "documents")))


def op9_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_personal_data(spark, sf_dir):
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op12_cross_tokenizer(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.grouped(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_secret_scan, op2_sharding, op3_hilbert_packing, op4_substring_dedup, op5_quality_rules, op6_lm_scores, op7_toxicity, op8_mixing, op9_top_k, op10_near_duplicates, op11_personal_data, op12_cross_tokenizer, op13_spelling_variants, pipeline]
    return {f.__name__: f for f in own}


#: The operators that learn, hash or place rows have no SQL and are tested against brute force.
TOP_K_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
select query_id, rank, vec_id, score from (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s) where rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": oracles.SUBSTRING, "op5_quality_rules": oracles.QUALITY, "op6_lm_scores": oracles.LM_SCORES, "op8_mixing": oracles.MIXING, "op9_top_k": TOP_K_SQL, "op10_near_duplicates": oracles.NEAR_DUPLICATES, "op13_spelling_variants": oracles.SPELLING}
