"""Periodic runs of words: stretches that repeat a block of q words TIMES times or more.

The texts of a slice stand in a row, each closed by a word of its own. Karp, Miller and Rosenberg's names are given to
blocks of 1, 2, 4, ... words: equal blocks of a level have equal names, made by numbering pairs of names of the level
before; a block that is found once has a name of its own and is never numbered again, so that levels end where nothing
repeats. How far two places agree, forward or backward, is found by descending levels. For a period q a grid with
steps of 2 q meets each run, as what agrees with itself q words on is at least (TIMES - 1) q >= 3 q words long; there a
block of 2^floor(log2 q) words has the name of the one q words on. Such candidates are extended both ways. Of candidates
with the same ends the smallest period counts: a longer one is its multiple (Fine and Wilf).

All in NumPy over a slice of texts of SLICE bytes, or one longer text; no hashes, no sorting of suffixes. n words take
time and memory of n log n at most.

Null texts and texts without words have no runs and collapse to nothing. Rows stay as they are, repeated ones and those
with null ids too; further columns go along, but for one named like the result. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import WORD, small_batches
from sparkloom.llm.tokens import SPACE, slices

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4
SLICE = 4 << 20
RESULT = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts in a row, and how many each text has."""
    trimmed = pc.ascii_trim(pc.fill_null(texts, ""), SPACE)
    lists = pc.split_pattern_regex(trimmed, f"[{SPACE}]+")
    sizes = np.where(pc.equal(trimmed, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy())
    words = pc.list_flatten(lists)
    return words.filter(pc.not_equal(words, "")), sizes.astype(np.int64)


def _named(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray | None:
    """Names of n blocks, of which those at the places at have keys: 0, 1, ... for keys found again, else a negative
    one of the place; None if no key is found again."""
    _, number, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts > 1
    if not again.any():
        return None
    names = -1 - np.arange(n)
    dense = np.cumsum(again) - 1
    names[at] = np.where(again[number], dense[number], names[at])
    return names


def levels(sequence: np.ndarray) -> list[np.ndarray]:
    """Names of the blocks of 1, 2, 4, ... words that begin at each place; negative numbers of sequence are unlike all
    others."""
    n, out = len(sequence), []
    at = np.flatnonzero(sequence >= 0)
    names = _named(sequence[at], at, n)
    while names is not None:
        out.append(names)
        size = 1 << (len(out) - 1)
        at = np.flatnonzero(names[: n - size] >= 0)
        at = at[names[at + size] >= 0]
        names = _named(names[at] * n + names[at + size], at, n)
    return out


def _agree(names: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words agree from the places a and b on, a < b. The sequence's last word is unlike all others."""
    far = np.zeros(len(a), np.int64)
    for k in reversed(range(len(names))):
        far += (names[k][a + far] == names[k][b + far]).astype(np.int64) << k
    return far


def _agree_before(names: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words agree before the places a and b, a < b."""
    far = np.zeros(len(a), np.int64)
    for k in reversed(range(len(names))):
        left = a - far - (1 << k)
        inside = left >= 0
        left = np.maximum(left, 0)
        far += (inside & (names[k][left] == names[k][left + b - a])).astype(np.int64) << k
    return far


def runs(sequence: np.ndarray, longest: int) -> np.ndarray:
    """start, length and period of all runs of a sequence that ends with a negative number, by start and period; none
    is longer than longest."""
    names, n, found = levels(sequence), len(sequence), []
    for k in range(len(names)):
        q = np.arange(1 << k, min(2 << k, longest // TIMES + 1))
        if not len(q):
            break
        points = np.maximum(-(-(n - q) // (2 * q)), 0)
        each = np.repeat(q, points)
        grid = (np.arange(len(each)) - np.repeat(np.cumsum(points) - points, points)) * 2 * each
        hit = names[k][grid] == names[k][grid + each]
        grid, each = grid[hit], each[hit]
        before = _agree_before(names, grid, grid + each)
        length = before + _agree(names, grid, grid + each) + each
        whole = length >= np.maximum(LEAST, TIMES * each)
        found.append(np.stack([grid - before, length, each], 1)[whole])
    if not found:
        return np.zeros((0, 3), np.int64)
    every = np.unique(np.concatenate(found), axis=0)  # by start, length and period
    least = np.ones(len(every), bool)
    least[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    every = every[least]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def of_texts(texts: pa.Array) -> pa.StructArray:
    """n_words, runs and collapsed (the words that no run repeats, joined by a space) of each text."""
    words, sizes = split(texts)
    number = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words)) + text  # a text's closing word stands between it and the next
    sequence = np.full(len(words) + len(sizes), -1, np.int64)
    sequence[place] = number
    found = runs(sequence, int(sizes.max(initial=0)))
    begins = ends - sizes + np.arange(len(sizes))
    own = np.searchsorted(begins, found[:, 0], "right") - 1
    repeated = np.zeros(len(sequence) + 1, np.int64)
    np.add.at(repeated, found[:, 0] + found[:, 2], 1)
    np.add.at(repeated, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(repeated)[place] == 0
    offsets = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    lists = pa.ListArray.from_arrays(offsets(np.bincount(own, minlength=len(sizes))), pa.StructArray.from_arrays([found[:, 0] - begins[own], found[:, 1], found[:, 2]], ["start", "length", "period"]))
    left = pa.ListArray.from_arrays(offsets(np.bincount(text[kept], minlength=len(sizes))), words.filter(pa.array(kept)))
    return pa.StructArray.from_arrays([pa.array(sizes), lists, pc.binary_join(left, " ")], ["n_words", "runs", "collapsed"])


def find(docs: DataFrame, column: str = "text", into: str = "periodic") -> DataFrame:
    """docs with a struct: n_words, runs (each with start, length and period, by start and period; a run isn't extended
    by a neighbouring word) and collapsed, the words without those that a run repeats after its first q."""
    small_batches(docs.sparkSession)
    docs = docs.drop(into)
    at = docs.columns.index(column)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(at), SLICE):
                rows = batch.slice(part.start, part.stop - part.start)
                yield rows.append_column(into, of_texts(rows.column(at)))

    return docs.mapInArrow(step, T.StructType([*docs.schema.fields, *T.StructType.fromDDL(f"`{into}` {RESULT}").fields]))


def with_cycles(text: Column, key: Column) -> Column:
    """text, or for one key in ten its words with a cycle: for h = crc32 of the decimal key and g = floor(h / 10), if
    h % 10 = 0, each word from the one numbered a = g % n on becomes word a + (i - a) % p, of p = 1 + floor((n - a) /
    (3 + g % 8)). A null key changes nothing."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def cycle(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.transform(words, lambda _, i: words[F.when(i >= a, a + (i - a) % p).otherwise(i)])

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when(h % 10 == 0, F.array_join(F.transform(F.array(words), cycle)[0], " ")).otherwise(text)


def summarised(found: DataFrame, column: str = "periodic") -> list[Column]:
    """Of what find() gives: n_runs, the longest run, and digests of the runs and of the collapsed text."""
    every = F.col(f"{column}.runs")
    longest = F.array_max(F.transform(every, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform(every, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size(every) > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return [
        F.size(every).cast("long").alias("n_runs"),
        (-longest["start"]).alias("start"),
        longest["length"].alias("length"),
        (-longest["period"]).alias("period"),
        F.floor(1000 * longest["length"] / -longest["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col(f"{column}.collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ]
