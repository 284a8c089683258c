"""The numbered queries: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, codes, extract, langid, lm, mixing, near, pii, quality, runs, topk, warc, weak
from sparkloom.llm.common import documents, pages


def byte_bpe() -> str:
    """The public vocabulary file of byte-level BPE, which must lie at the same path on every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def op2_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak.classify(documents(spark, sf_dir))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(pages(spark, sf_dir))


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = pages(spark, sf_dir).select("page_id", "url", "html")
    found = extract.main_text(table, extract.fit(table))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op6_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    tokens = bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), tokenizer or byte_bpe())
    return tokens.select("doc_id", "tokens.n_tokens", "tokens.ids_sha256", "tokens.decoded_sha256")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.annotate(documents(spark, sf_dir))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir).select("doc_id", "text"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.fit(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op11_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", *pii.summarised())


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", runs.with_cycles(F.col("text"), F.col("doc_id")).alias("text"))
    found = runs.find(docs)
    return found.select("doc_id", *runs.summarised(found))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_weak_labels, op3_warc, op4_extract, op5_near, op6_bpe, op7_topk, op8_quality, op9_lm, op10_langid, op11_private, op12_codes, op13_runs)}
