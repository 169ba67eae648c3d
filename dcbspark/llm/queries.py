"""The registered ``opN_`` queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, masked_lm, maxscore, mixing, near_dup, pieces, pseudonyms, secrets, token_files, toxicity
from .common import materialise


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train=fold != 0)
    rows = toxicity.scored(docs.select("doc_id", "text", "lang"), model)
    return rows.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"), F.col("__toxic").alias("flagged"))


def op3_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return maxscore.top_k(vectors, F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.spans(documents(spark, sf_dir))
    base = F.array_join("base", ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(base, 256).alias("base_sha256"), F.array_join("all", ",").alias("spans"))


def op5_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.scored(documents(spark, sf_dir))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_groups(documents(spark, sf_dir), words=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(documents(spark, sf_dir), pieces.default_model(spark), keep_ids=False)


#: The key of the registered query's pseudonyms where ``dcbspark.pseudonyms.key`` is unset: it is public, so for tests only.
TEST_KEY = "a public key for tests"


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("dcbspark.pseudonyms.key", None) or TEST_KEY
    return pseudonyms.pseudonymised(documents(spark, sf_dir), key.encode())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(mixing.hashed(documents(spark, sf_dir).select("doc_id", "text", "source")).drop("text"), "mix-rows")
    taken = mixing.copies(rows, mixing.plan(rows))
    return taken.select("doc_id", "source", F.col("__tokens").alias("n_tokens"), F.col("__weight").alias("weight"), F.col("__place").alias("place"), F.col("__copies").alias("copies"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(documents(spark, sf_dir), token_files.default_tokenizer(spark)).select("doc_id", "start", "n_tokens", "ids_crc32")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By name, in the order of their numbers."""
    own = (op1_exact_dedup, op2_toxicity, op3_maxscore, op4_secret_scan, op5_masked_lm, op6_minhash_near_dedup, op7_sentencepiece, op8_pseudonyms, op9_mixing, op10_token_files, pipeline)
    return {f.__name__: f for f in own}
