"""A training-data pipeline: quality rules, language identification, near-duplicate removal, mixing and tokens.

Each stage works on all that the one before it kept, written as Parquet and read again. All but the last return the
columns of documents.

Odd rows: null, empty and wordless texts fail the quality rules, so later stages never see them. Null languages and
sources are groups of their own; a null language teaches nothing. Rows with a null id are judged as any other, and
come into the mix by their text. Very long texts are read whole by every stage. Repeated rows are copies, of which one
stays. Extra columns pass through; the last stage returns its own. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bpe, langid, mixing, near, quality
from sparkloom.llm.common import Scratch, documents
from sparkloom.llm.queries import byte_bpe

#: Percent of two documents' distinct five-word shingles from which they are near-duplicates.
SIMILAR = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep to the base rules and to the cutoffs of their language and source."""
    return quality.filter_documents(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is certain and of which that language's own texts are no better: what is
    in a language that no label names, or in none, goes."""
    return langid.identify(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near.deduplicate(docs, SIMILAR)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix: doc_id, lang, source, its token ids, and digests of these and of what they decode to."""
    found = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), byte_bpe(), keep_ids=True)
    return found.select("doc_id", "lang", "source", "tokens.n_tokens", "tokens.ids", "tokens.ids_sha256", "tokens.decoded_sha256")


STAGES = [("quality rules", quality_rules), ("language", language), ("near dedup", near_dedup), ("mixture", mixture), ("tokens", tokens)]

#: Hashed models, sketches and token ids can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
