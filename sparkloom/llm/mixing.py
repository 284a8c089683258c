"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash. For a budget of words a source gives its documents whose hash is at most a threshold, so
that a smaller budget's documents are always among a larger one's. Thresholds are found without sorting: sizes are
summed by source and the hash's top byte; only the bucket that the budget ends in is refined by the next byte, and so
on until it holds a single hash. That last group goes in if that brings the source nearer to its budget. A budget
beyond the source's size takes the whole source as often as it fits, and the rest by threshold.

Sources are given their targets in one task, a slim row per source. Null texts have size 0. Null sources are a source of their own. A document with a null id is hashed by its text.
Rows equal in id (or, without one, in text) share a hash and go in together. An empty table has no sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, key_of, n_words, small

WEIGHTS = (5, 2, 1)
#: Words taken from all sources, by their words, and the most that any gives.
SHARE, MOST = 1.5, 2
#: Hashes have 14 hexadecimal digits; a level of the histogram sums by the next two.
DIGITS, STEP = 14, 8
BITS = DIGITS * 4


def hash_of(doc_id: Column, text: Column) -> Column:
    key = F.coalesce(doc_id.cast("string"), text, F.lit(""))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes (source, source_size) with the words that each source owes. Sources in code point order, null last, have
    the weights in turn. Sources are filled evenly by weight up to most times their size: in the order of size by
    weight, a source is full if its part of what those before it leave is more than it can give."""
    all_, order = W.partitionBy(), W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights) + 1
    out = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).cast("long")).withColumn("most", F.col("source_size") * most)
    before = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    taken, used = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("most", "weight"))
    out = out.withColumns({"budget": F.sum("source_size").over(all_) * F.lit(float(share)), "all_weight": F.sum("weight").over(all_), "taken_before": taken, "weight_before": used})
    full = (F.col("budget") - F.col("taken_before")) / (F.col("all_weight") - F.col("weight_before")) * F.col("weight") > F.col("most")
    out = out.withColumn("full", full)
    spent, gone = (F.sum(F.when(F.col("full"), F.col(c)).otherwise(0)).over(all_) for c in ("most", "weight"))
    out = out.withColumns({"spent": spent, "gone": gone})
    even = (F.col("budget") - F.col("spent")) / F.nullif(F.col("all_weight") - F.col("gone"), F.lit(0)) * F.col("weight")
    return out.select(*sizes.columns, F.when(F.col("full"), F.col("most").cast("double")).otherwise(even).alias("target"))


def thresholds(rows: DataFrame, owed: DataFrame, scratch: Scratch) -> DataFrame:
    """owed (key, source, source_size, target) with `whole`, how often all of the source is taken, and `threshold`, up
    to which hashes are taken once more. rows: key, hash, size."""
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    state = owed.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    state = scratch.write(state.withColumns({"threshold": F.lit(None).cast("long"), "bucket": F.lit(None).cast("long"), "sum_below": F.lit(0).cast("long")}), "thresholds_0")
    for level in range(1, BITS // STEP + 1):
        shift = BITS - STEP * level
        open_ = state.where("threshold is null").select("key", "rest", "sum_below", "bucket")
        if (n := open_.count()) == 0:
            break
        inside = rows.join(small(open_.select("key", "bucket"), rows=n), "key")
        if level > 1:
            inside = scratch.write(inside.where(F.shiftrightunsigned("hash", shift + STEP) == F.col("bucket")).select("key", "hash", "size"), f"inside_{level}")
            rows = inside
        sums = inside.groupBy("key", F.shiftrightunsigned("hash", shift).alias("part")).agg(F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        running = F.sum("size").over(W.partitionBy("key").orderBy("part"))
        ends = sums.join(small(open_, rows=n), "key").withColumn("upto", F.col("sum_below") + running).where(F.col("upto") > F.col("rest"))
        first = ends.groupBy("key").agg(F.min_by(F.struct("part", "size", "low", "high", "upto"), "part").alias("end"))
        e = F.col("end")
        nearer = 2 * F.col("rest") >= e["upto"] - e["size"] + e["upto"]
        found = F.when(e.isNull(), F.lit((1 << BITS) - 1)).when(e["low"] == e["high"], F.when(nearer, e["low"]).otherwise(e["low"] - 1))
        was_open = F.col("threshold").isNull()
        state = state.join(small(first, rows=n), "key", "left").withColumns(
            {"threshold": F.when(was_open, found).otherwise(F.col("threshold")), "bucket": F.when(was_open, e["part"]).otherwise(F.col("bucket")), "sum_below": F.when(was_open, e["upto"] - e["size"]).otherwise(F.col("sum_below"))}
        )
        state = scratch.write(state.drop("end"), f"thresholds_{level}")
    return state


def plan(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The slim table of docs (doc_id, key, source, hash, size), written, and the thresholds of its sources."""
    slim = docs.select("doc_id", "source", key_of(F.col("source")).alias("key"), hash_of(F.col("doc_id"), F.col("text")).alias("hash"), n_words(F.col("text")).alias("size"))
    slim = scratch.write(slim, "sizes")
    sizes = slim.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    return slim, thresholds(slim.select("key", "hash", "size"), targets(sizes, weights, share, most), scratch)


def repeats() -> Column:
    """How often a document is taken."""
    return F.col("whole") + (F.col("hash") <= F.col("threshold")).cast("long")


def mixed(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken, its words in the mix."""
    slim, found = plan(docs, Scratch(docs.sparkSession, "mixing"))
    joined = slim.join(small(found.drop("source")), "key")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * repeats()).alias("taken"), repeats().alias("repeats"))


def mix(docs: DataFrame) -> DataFrame:
    """docs' rows, each as often as the mix takes it."""
    _, found = plan(docs, Scratch(docs.sparkSession, "mixing"))
    found = found.select(F.col("key").alias("__key"), "whole", "threshold").withColumnsRenamed({"whole": "__whole", "threshold": "__threshold"})
    tagged = docs.withColumns({"__key": key_of(F.col("source")), "__hash": hash_of(F.col("doc_id"), F.col("text"))}).join(small(found), "__key")
    times = (F.col("__whole") + (F.col("__hash") <= F.col("__threshold")).cast("long")).cast("int")
    return tagged.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1))))).where(F.col("__turn") <= times).select(*docs.columns)
