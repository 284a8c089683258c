"""Quality classifier from weak labels.

Overlapping heuristic labellers each call a text good or bad, or abstain. How often each of them is right is estimated
from their agreement alone, by expectation-maximisation over the counts of vote patterns (at most three to the number
of labellers, whatever the corpus); that gives every text a posterior. A linear scorer over hashed features, shapes of
three neighbouring characters and words, then learns the posteriors of a bounded sample, by gradients that the
executors sum, and scores all texts.

The fit uses at most about `sample` texts, chosen row by row, so that copies don't come in or stay out together;
votes, patterns and scores cover all. Null texts,
and those without words, are bad by every labeller that votes, and are never kept. Long texts are read whole. Equal
texts get equal results; an empty table gives no rows. Extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import quality
from sparkloom.llm.common import Scratch
from sparkloom.llm.tokens import slices, words_of

#: Most texts that the scorer is fitted on, about.
SAMPLE = 20_000
SHAPES, WORDS = 16**3, 1 << 12
DIMENSIONS = SHAPES + WORDS + 1  # the last is constant
ROUNDS, STEPS = 60, 40
#: Code points whose shapes are counted at once; bytes of texts whose words are cut at once.
BLOCK, TEXTS = 1 << 20, 4 << 20
#: Function words of European languages.
FREQUENT = "the of and to in a is that for with der die und das ein zu von de la le les des et en un une que el los y se por".split()


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 2).otherwise(1)


def labellers(p: str = "") -> dict[str, Column]:
    """Votes by labeller, 0 for bad, 1 for none, 2 for good, from the counts of quality.measure() and of read()."""
    c = lambda k: F.col(f"{p}{k}")
    n, chars, lines = c("n_words"), c("word_chars"), c("n_lines")
    return {
        "length": _vote(n >= 80, n < 5),
        "symbols": _vote(100 * c("n_symbols") <= chars, 100 * c("n_symbols") > 5 * chars),
        "marks": _vote(20 * c("n_marked") <= n, 20 * c("n_marked") > 3 * n),
        "letters": _vote(100 * c("n_letters") >= 90 * chars, 100 * c("n_letters") < 80 * chars),
        "repeats": _vote((n >= 30) & (10 * c("n_repeat_words") <= 2 * n), 10 * c("n_repeat_words") > 4 * n),
        "vocabulary": _vote((n >= 30) & (10 * c("n_distinct") >= 5 * n), (n >= 60) & (10 * c("n_distinct") < 3 * n)),
        "lines": _vote((lines >= 3) & (10 * c("n_dup_lines") <= lines), 10 * c("n_dup_lines") > 4 * lines),
        "capitals": _vote((n >= 20) & (10 * c("n_upper") <= chars), 10 * c("n_upper") > 3 * chars),
        "word_length": _vote((n >= 20) & (chars >= 3 * n) & (chars <= 7 * n), (chars > 12 * n) | (chars < 2 * n)),
        "frequent": _vote(100 * c("n_frequent") >= 8 * n, (n >= 30) & (100 * c("n_frequent") < n)),
        "stops": _vote((n >= 30) & (60 * c("n_stops") >= n), (n >= 60) & (c("n_stops") == 0)),
    }


def votes(docs: DataFrame, text: str = "text", prefix: str = "__w_") -> DataFrame:
    """docs with <prefix>features, and <prefix>pattern: the votes as digits of a number to base three."""
    out = quality.measure(docs, text, prefix).withColumn(f"{prefix}read", read(F.col(text)))
    out = out.withColumns({f"{prefix}{c}": F.col(f"{prefix}read.{c}") for c in ("features", *COUNTS)})
    pattern = F.lit(0)
    for i, v in enumerate(labellers(prefix).values()):
        pattern = pattern + v * 3**i
    return out.withColumn(f"{prefix}pattern", pattern)


class Labels(NamedTuple):
    """What expectation-maximisation finds: of each labeller and class (bad, good) the probabilities of its votes, if it
    casts one; the share of good texts; and the posterior of each pattern."""

    votes: np.ndarray
    good: float
    posterior: dict[int, float]

    def accuracy(self) -> np.ndarray:
        """Of each labeller: how often a vote that it casts is right."""
        right = self.votes[:, 1, 2] * self.good + self.votes[:, 0, 0] * (1 - self.good)
        cast = (self.votes[:, 1, [0, 2]].sum(1) * self.good) + (self.votes[:, 0, [0, 2]].sum(1) * (1 - self.good))
        return right / np.maximum(cast, 1e-9)


def agreement(patterns: pd.DataFrame) -> Labels:
    """Labels from the counts of patterns (pattern, n), beginning with the majority of votes."""
    k = len(labellers())
    table, n = np.array([[p // 3**i % 3 for i in range(k)] for p in patterns["pattern"]]).reshape(-1, k), patterns["n"].to_numpy(float)
    if not len(n):
        return Labels(np.full((k, 2, 3), 1 / 3), 0.5, {})
    balance = (table - 1).sum(1)
    good = np.where(balance > 1, 0.95, np.where(balance < 1, 0.05, 0.5))
    for _ in range(ROUNDS):
        share = np.clip((good * n).sum() / n.sum(), 1e-3, 1 - 1e-3)
        p = np.empty((k, 2, 3))
        for y, q in ((1, good), (0, 1 - good)):
            for v in range(3):
                p[:, y, v] = ((table == v) * (q * n)[:, None]).sum(0) + 1
        p[:, :, 1] = 0  # who abstains says nothing
        p /= p.sum(2, keepdims=True)
        p[:, :, 1] = 1
        odds = np.log(share / (1 - share)) + sum(np.log(p[i, 1, table[:, i]] / p[i, 0, table[:, i]]) for i in range(k))
        good = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return Labels(p, float(share), dict(zip(patterns["pattern"].tolist(), good.tolist(), strict=True)))


def _classes() -> np.ndarray:
    """The shape of each code point under 256: letters by case, digits, white space, and common marks by themselves."""
    out = np.full(256, 15, np.int64)
    for i in range(256):
        c = chr(i)
        out[i] = 0 if c.isalpha() and c == c.lower() else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in "\n" else 4 if c.isspace() else 15
    for i, c in enumerate(".,!?#*$%&|", 5):
        out[ord(c)] = i
    return out


CLASSES = _classes()


WHITE, STOPS, MARKS = [3, 4], [5, 7, 8], list(range(5, 16))
COUNTS = ("n_letters", "n_upper", "n_marked", "n_stops", "n_frequent")
FREQUENT_HASHES = pd.util.hash_array(np.array(FREQUENT, object), categorize=False)


def features(text: str | None, words: np.ndarray, frequent: int) -> tuple[np.ndarray, np.ndarray, tuple[int, ...]]:
    """Indices and values of a text's features, of length one and the constant; and COUNTS: letters, capitals, words
    that end in several marks or are one, marks that end a sentence, and function words. words: the buckets of its
    words; frequent: how many of them are function words."""
    counts = np.zeros(DIMENSIONS - 1, np.int64)
    padded = f" {text or ''} "
    for i in range(0, len(padded), BLOCK):
        points = np.frombuffer(padded[i : i + BLOCK + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        shape = np.where(points < 256, CLASSES[np.minimum(points, 255)], 0)
        if len(shape) > 2:
            counts[:SHAPES] += np.bincount(shape[:-2] * 256 + shape[1:-1] * 16 + shape[2:], minlength=SHAPES)
    cube = counts[:SHAPES].reshape(16, 16, 16)
    middle = cube.sum((0, 2))  # of every character but the two that pad
    marked = cube[np.ix_(MARKS, MARKS, WHITE)].sum() + cube[np.ix_(WHITE, MARKS, WHITE)].sum()
    found = [middle[0] + middle[1], middle[1], marked, cube.sum(0)[np.ix_(STOPS, WHITE)].sum()]
    counts[SHAPES:] += np.bincount(words, minlength=WORDS)
    at = np.flatnonzero(counts)
    value = np.sqrt(counts[at].astype(np.float64))
    half = at < SHAPES
    for part in (half, ~half):  # shapes and words weigh the same
        if part.any():
            value[part] /= np.sqrt(2 * (value[part] ** 2).sum())
    return np.append(at, DIMENSIONS - 1).astype(np.uint16), np.append(value, 1).astype(np.float16), (*map(int, found), int(frequent))


def features_of(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, tuple[int, ...]]]:
    """features() of each text, with their words cut together."""
    number, sizes, hashes = words_of(texts)
    ends = np.cumsum(sizes)
    bucket = (hashes % np.uint64(WORDS)).astype(np.int64)[number] if len(number) else number
    often = np.cumsum(np.isin(hashes, FREQUENT_HASHES)[number]) if len(number) else number
    so_far = np.concatenate([[0], often])[ends]
    parts = zip(texts, ends - sizes, ends, np.diff(so_far, prepend=0), strict=True)
    return [features(t.as_py(), bucket[start:end], frequent) for t, start, end, frequent in parts]


def read(text: Column) -> Column:
    """Struct of a text's features as bytes, indices and then values of two bytes each, and of COUNTS."""

    @F.arrow_udf("struct<features: binary, " + ", ".join(f"{c}: long" for c in COUNTS) + ">")
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [f for part in slices(batch, TEXTS) for f in features_of(batch[part])]
            columns = [pa.array([r[0].tobytes() + r[1].tobytes() for r in rows], pa.binary())]
            columns += [pa.array([r[2][i] for r in rows], pa.int64()) for i in range(len(COUNTS))]
            yield pa.StructArray.from_arrays(columns, ["features", *COUNTS])

    return pack(text)


def _matrix(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = [np.frombuffer(r.as_py(), np.uint16) for r in rows]
    sizes = np.array([len(d) // 2 for d in data], np.int64)
    at = np.concatenate([np.empty(0, np.int64), *(d[: len(d) // 2].astype(np.int64) for d in data)])
    value = np.concatenate([np.empty(0), *(d[len(d) // 2 :].view(np.float16).astype(np.float64) for d in data)])
    return np.repeat(np.arange(len(data)), sizes), at, value


def _gradient(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIMENSIONS), 0
    for batch in batches:
        row, at, value = _matrix(batch.column(0))
        wanted = batch.column(1).to_numpy()
        p = 1 / (1 + np.exp(-np.bincount(row, weights[at] * value, minlength=len(wanted))))
        total += np.bincount(at, (p - wanted)[row] * value, minlength=DIMENSIONS)
        n += len(wanted)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["gradient", "n"])


def fit(sample: DataFrame) -> np.ndarray:
    """Weights of the scorer from a bounded sample (features, posterior), in few partitions; a gradient per partition
    reaches the driver each step."""
    weights, momentum, scale = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    for step in range(1, STEPS + 1):
        parts = sample.mapInArrow(partial(_gradient, weights=weights), "gradient binary, n long").collect()
        n = sum(r["n"] for r in parts)
        if not n:
            return weights
        gradient = sum(np.frombuffer(r["gradient"]) for r in parts) / n + 1e-5 * weights
        momentum, scale = 0.8 * momentum + 0.2 * gradient, 0.95 * scale + 0.05 * gradient**2
        weights = weights - 0.5 * (momentum / (1 - 0.8**step)) / (np.sqrt(scale / (1 - 0.95**step)) + 1e-6) * min(1.0, 20 / (20 + step))
    return weights


def scored(packed_: Column, weights: np.ndarray) -> Column:
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch[start : start + 1000]
                row, at, value = _matrix(part)
                yield pa.array(1 / (1 + np.exp(-np.bincount(row, weights[at] * value, minlength=len(part)))))

    return score(packed_)


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, votes (a digit per labeller: 0 bad, 1 none, 2 good), posterior, score and kept. The scorer
    is fitted on at most about `sample` texts."""
    scratch = Scratch(docs.sparkSession, "weak")
    slim = votes(docs.select("doc_id", "text"))
    slim = scratch.write(slim.select("doc_id", F.col("__w_pattern").alias("pattern"), F.col("__w_n_words").alias("n_words"), F.xxhash64("doc_id", "text").alias("key"), F.col("__w_features").alias("features")), "slim")
    patterns = slim.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toPandas()  # 3 ** 11 rows at most
    labels = agreement(patterns)
    known = docs.sparkSession.createDataFrame([(int(k), float(v)) for k, v in labels.posterior.items()], "pattern int, posterior double")
    slim = slim.join(F.broadcast(known), "pattern")
    share = int(min(1.0, sample / max(1, int(patterns["n"].sum()))) * (1 << 30))
    chosen = scratch.write(slim.where((F.col("n_words") > 0) & (F.pmod("key", F.lit(1 << 30)) < share)).select("features", "posterior").coalesce(16), "chosen")
    out = slim.withColumn("score", scored(F.col("features"), fit(chosen)))
    digits = F.concat(*[(F.floor(F.col("pattern") / 3**i) % 3).cast("string") for i in range(len(labellers()))])
    return out.select("doc_id", digits.alias("votes"), "posterior", "score", ((F.col("n_words") > 0) & (F.col("score") >= 0.5)).alias("kept"))
