"""Exact top-k search by inner product with vector-approximation files.

Equal vectors are one class, which keeps the k + 1 smallest ids of its rows, more than any query can be given of it.
An approximation table holds each class as one cell number per dimension. A scan of it bounds every score from
below and above, a block of queries at a time; a class survives if its upper bound reaches the k-th best lower
bound. Survivors' exact vectors are then read in the order of their upper bounds: first the 2k most promising of a
query, then only those whose bound still reaches the k-th best exact score, so that the result is certain.

Components x become floor(scale * x). Vectors that are null, or hold null or non-finite components, and rows with a
null id take no part; shorter vectors count as padded with zeros. Equal scores rank by smaller id. A query's own id
is no candidate; other repeated ids are candidates each time, queries with one id are asked once (the least vector).
Empty tables give no rows. A component or a score that a long can't hold stops the search with Spark's overflow error;
below that, bounds are widened by what doubles can't tell apart.

Classes are known by 128 bits of hashes: of n different vectors some two are taken for one with probability
n * n / 2**129.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, small

#: Cells of a dimension; a number of one byte.
CELLS = 256
#: Queries of one scan: what is sent to the executors at once stays under this many vectors.
QUERIES = 16_384
#: Queries and vectors whose bounds are computed together.
TILE, ROWS = 256, 4096


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return vector.isNotNull() & fine


def _cells(batches: Iterator[pa.RecordBatch], low: np.ndarray, width: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = matrix(batch.column(1), len(low))
        cells = np.minimum((v - low) // width, CELLS - 1).astype(np.uint8)
        data = [row.tobytes() for row in cells]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), batch.column(2)], ["key", "cells", "only"])


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of dims numbers, padded with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _scan(batches: Iterator[pa.RecordBatch], shared, low: np.ndarray, width: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Of a partition's classes: those whose upper bound reaches the k-th best lower bound seen so far."""
    ids, queries = shared.value
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    unsure = queries.shape[1] * np.abs(queries).max() * (np.abs(low) + CELLS * width).max() * 2.0**-50
    best = np.full((len(ids), k), -np.inf)  # lower bounds
    kept: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            own, only, single = part.column(0).to_numpy(), part.column(2).fill_null(0).to_numpy(), part.column(2).is_valid().to_numpy(zero_copy_only=False)
            cells = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(own), -1)
            floor = low + cells * width
            ceil = floor + width - 1
            for q in range(0, len(ids), TILE):
                tile = slice(q, q + TILE)
                lower = plus[tile] @ floor.T + minus[tile] @ ceil.T - unsure
                upper = plus[tile] @ ceil.T + minus[tile] @ floor.T + unsure
                same = (ids[tile, None] == only[None, :]) & single[None, :]
                lower[same] = upper[same] = -np.inf
                best[tile] = -np.partition(-np.concatenate([best[tile], lower], 1), k - 1, 1)[:, :k]
                at = np.nonzero((upper >= best[tile].min(1)[:, None]) & ~same)
                kept.append((at[0] + q, own[at[1]], lower[at], upper[at]))
        if sum(len(x[0]) for x in kept) > 500_000:
            kept = [_still(kept, best)]
    if kept:
        q, v, lo, up = _still(kept, best)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(v), pa.array(lo), pa.array(up)], ["query_id", "key", "lower", "upper"])


def _still(kept: list[tuple[np.ndarray, ...]], best: np.ndarray) -> tuple[np.ndarray, ...]:
    q, v, lo, up = (np.concatenate(x) for x in zip(*kept, strict=True))
    ok = up >= best[q].min(1)
    return q[ok], v[ok], lo[ok], up[ok]


def _dot(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def classes(vectors: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """Of vectors (vec_id, v) each different one: key, v, ids (the k + 1 smallest, each with the count of its rows) and
    only, its id if it has a single one. Vectors that occur once are not shuffled."""
    hashed = vectors.withColumns({"key": F.xxhash64("v"), "key2": F.xxhash64(F.lit(1), F.col("v"))})
    several = scratch.write(hashed.groupBy("key", "key2").agg(F.count("*").alias("rows")).where("rows > 1"), "several")
    tagged = hashed.join(small(several, 60), ["key", "key2"], "left")
    once = tagged.where("rows is null").select("key", "v", F.array(F.struct("vec_id", F.lit(1).cast("long").alias("n"))).alias("ids"))
    by_id = tagged.where("rows is not null").groupBy("key", "key2", "vec_id").agg(F.count("*").alias("n"), F.first("v").alias("v"))
    place = F.row_number().over(W.partitionBy("key", "key2").orderBy("vec_id"))
    least = by_id.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("key", "key2")
    more = least.agg(F.first("v").alias("v"), F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("ids")).select("key", "v", "ids")
    found = once.union(more)
    return scratch.write(found.withColumn("only", F.when(F.size("ids") == 1, F.col("ids")[0]["vec_id"])), "classes")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank from 1, vec_id and score of each query's k best. Both tables: vec_id, embedding."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "topk")
    vectors, queries = (t.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("v")) for t in (vectors, queries))
    asked = scratch.write(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n = asked.count()
    table = classes(vectors, k, scratch)
    dims = table.agg(F.max(F.size("v"))).first()[0] or 0
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not dims or not n:
        return empty
    component = lambda i: F.coalesce(F.get("v", F.lit(i)), F.lit(0))
    ends = table.agg(*[f(component(i)) for i in range(dims) for f in (F.min, F.max)]).first()
    low, high = (np.array(ends[i::2], np.float64) for i in (0, 1))
    width = np.floor((high - low) / CELLS) + 1
    approximations = scratch.write(table.select("key", "v", "only").mapInArrow(partial(_cells, low=low, width=width), "key long, cells binary, only long"), "approximations")
    blocks = -(-n // QUERIES)
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        shared = spark.sparkContext.broadcast((block.column("vec_id").to_numpy(), matrix(block.column("v").combine_chunks(), dims)))
        part = approximations.mapInArrow(partial(_scan, shared=shared, low=low, width=width, k=k), "query_id long, key long, lower double, upper double")
        bounds = scratch.write(part, "bounds", "append")
        shared.destroy()
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("lower")))
    certain = bounds.withColumn("place", place).where(F.col("place") == k).select("query_id", F.col("lower").alias("least"))
    survivors = bounds.join(certain, "query_id", "left").where(F.col("least").isNull() | (F.col("upper") >= F.col("least")))
    survivors = survivors.groupBy("query_id", "key").agg(F.max("upper").alias("upper"))
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("upper"), "key"))
    survivors = scratch.write(survivors.withColumn("turn", order), "survivors")

    def exact(wanted: DataFrame) -> DataFrame:
        """query_id, vec_id and score of each candidate of the classes wanted, a row for each of its rows up to k."""
        rows = table.join(small(wanted.select("query_id", "key"), 64), "key")
        scored = rows.join(small(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), 8 * dims, n), "query_id").select("query_id", "ids", _dot(F.col("v"), F.col("q")).alias("score"))
        ids = scored.select("query_id", F.inline("ids"), "score").where("vec_id <> query_id")
        return ids.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k))))).select("query_id", "vec_id", "score")

    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    first = scratch.write(exact(survivors.where(F.col("turn") <= 2 * k)), "first")
    reached = first.withColumn("rank", best).where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    rest = survivors.where(F.col("turn") > 2 * k).join(reached, "query_id", "left").where(F.col("reached").isNull() | (F.col("upper") >= F.col("reached")))
    second = exact(scratch.write(rest.select("query_id", "key"), "rest"))
    return first.union(second).withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
