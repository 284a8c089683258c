"""Compression of vectors into a code of one byte per part, by codebooks learned part by part.

Components x become floor(256 * x); vectors are cut into PARTS equal consecutive parts, each position with a codebook
of its own. Kept vectors are laid out as columnar blocks: a block holds one dimension after the other, so that
distances to all entries of a codebook add up dimension by dimension. A round adds each part to its nearest entry's
sums and counts (np.add.at on int64 tensors of fixed size); the tensors of the blocks merge through the reduction tree
of RDD.treeAggregate, and only the last few reach the driver. Blocks are a table of the shared folder, so that a lost
executor's are read again. Tensors and codebooks are as large for any number of vectors.

Vectors that are null or hold null or non-finite components are dropped. Shorter vectors count as padded with zeros to
the longest one's size, rounded up to a multiple of PARTS. Integers beyond +-LARGEST count as that, so that distances
of up to 512 dimensions fit a long; a label whose errors don't fit one has a null label_error. Entries begin as the
parts of the ENTRIES first vectors by id, nulls last, equal ids by vector; fewer vectors make fewer entries. Nearest
entries tie to the lower index, entries that nothing is nearest to stay. Repeated rows count each time, and null labels
are one label. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import Scratch, key_of, small
from sparkloom.llm.topk import matrix, usable

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 26
#: Levels of the reduction tree.
DEPTH = 3


def _integers(vectors: pa.Array, dims: int) -> np.ndarray:
    """A row per dimension."""
    return np.clip(np.floor(matrix(vectors, dims) * SCALE), -LARGEST, LARGEST).astype(np.int32).T


def blocks(vectors: DataFrame, dims: int) -> DataFrame:
    """A row per batch of usable vectors (vec_id, label, embedding): the ids, the labels and the integers, one
    dimension after the other."""
    kinds = [T.StructField(c, T.ArrayType(vectors.schema[c].dataType)) for c in ("vec_id", "label")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(c)) for c in ("vec_id", "label")]
            data = np.ascontiguousarray(_integers(batch.column("embedding"), dims)).tobytes()
            yield pa.RecordBatch.from_arrays([*lists, pa.array([data], pa.binary())], ["vec_id", "label", "data"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(cut, T.StructType([*kinds, T.StructField("data", T.BinaryType())]))


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a part's columns (dimensions x vectors): the index of the nearest entry and the squared distance to it."""
    far = np.zeros((len(entries), part.shape[1]), np.int64)
    for column, of_entries in zip(part.astype(np.int64), entries.T, strict=True):
        gap = column[None, :] - of_entries[:, None]
        far += gap * gap
    at = far.argmin(0)
    return at, far[at, np.arange(part.shape[1])]


def _parts(data: bytes, dims: int) -> np.ndarray:
    """parts x dimensions of a part x vectors"""
    return np.frombuffer(data, np.int32).reshape(PARTS, dims // PARTS, -1)


def _round(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after all vectors have moved their nearest entries."""
    _, n, width = books.shape

    def add(total: tuple[np.ndarray, np.ndarray], data: bytes) -> tuple[np.ndarray, np.ndarray]:
        sums, counts = total
        for p, part in enumerate(_parts(data, PARTS * width)):
            at, _ = nearest(part, books[p])
            np.add.at(sums[p], at, part.T)
            np.add.at(counts[p], at, 1)
        return sums, counts

    def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return a[0] + b[0], a[1] + b[1]

    zero = np.zeros((PARTS, n, width), np.int64), np.zeros((PARTS, n), np.int64)
    sums, counts = table.select("data").rdd.map(lambda row: bytes(row[0])).treeAggregate(zero, add, merge, DEPTH)
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)


def fit(kept: DataFrame, table: DataFrame, dims: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x dimensions of a part) of kept, whose blocks are table."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").toArrow().column(0).combine_chunks()
    books = _integers(first, dims).reshape(PARTS, dims // PARTS, -1).swapaxes(1, 2).astype(np.int64)
    for _ in range(rounds):
        books = _round(table, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(table: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits per part) and error of every vector of the blocks."""
    _, _, width = books.shape
    fields = [T.StructField(c, table.schema[c].dataType.elementType) for c in ("vec_id", "label")]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                parts = _parts(batch.column("data")[i].as_py(), PARTS * width)
                found = [nearest(part, books[p]) for p, part in enumerate(parts)]
                codes = np.ascontiguousarray(np.stack([at for at, _ in found], 1).astype(np.uint8))
                own = [batch.column(c)[i].values for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([row.tobytes().hex() for row in codes]), pa.array(sum(far for _, far in found))], ["vec_id", "label", "code", "error"])

    return table.mapInArrow(assign, T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def decode(codes: DataFrame, books: np.ndarray, into: str = "approximation") -> DataFrame:
    """codes with the vector that each code stands for."""
    entries = F.lit(books.reshape(PARTS, -1).tolist())  # a codebook's entries one after the other
    width = books.shape[2]
    index = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    parts = [F.slice(entries[p], index(p) * width + 1, width) for p in range(PARTS)]
    return codes.withColumn(into, F.transform(F.concat(*parts), lambda x: x / SCALE))


def compress(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code and error of the usable vectors of (vec_id, label, embedding), and the codebooks."""
    scratch = Scratch(vectors.sparkSession, "codes")
    kept = vectors.select("vec_id", "label", "embedding").where(usable(F.col("embedding")))
    longest = kept.agg(F.max(F.size("embedding"))).first()[0]  # null if there is none
    dims = PARTS * max(1, -(-(longest or 0) // PARTS))
    table = scratch.write(blocks(kept, dims), "blocks")
    books = fit(kept, table, dims) if longest is not None else np.zeros((PARTS, 0, 1), np.int64)
    return scratch.write(encode(table, books), "codes"), books


def compressed(vectors: DataFrame) -> DataFrame:
    """What compress() gives, with the errors of each label added up and the codebooks' digest."""
    codes, books = compress(vectors)
    codes = codes.withColumn("__label", key_of(F.col("label")))
    sums = codes.groupBy("__label").agg(F.try_sum("error").alias("label_error"))
    out = codes.join(small(sums), "__label")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
