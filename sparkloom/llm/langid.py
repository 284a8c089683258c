"""Language identification by multinomial naive Bayes over hashed character n-grams.

fit() counts the n-grams of labelled texts on the executors and leaves a matrix of log probabilities, buckets by
languages, whose size is bounded by MATRIX_BYTES; it is broadcast. predict() looks up the rows of a text's n-grams
and adds them, block by block, in numpy; a prediction sees the text alone.

At most about per_language texts of each language are learned from, sampled row by row, so that copies of a text don't
come in or stay out together: a classifier needs no more, and the bound keeps the fit's cost fixed. Counting texts by
language covers them all.

The posterior of a long text is nearly 1 for some language whatever the text is. So a prediction also has its surprise:
by how much the text's mean log probability per n-gram in that language falls short of what the language's own texts
have on average, which follows from the matrix. identify() rejects texts by both.

Null texts and texts without a letter are `und` with score 0. Null languages teach nothing. Without any labelled
text everything is `und`. Equal texts get equal predictions; ties go to the language first in code point order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import small_batches

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Most labelled texts per language that a model is fitted on.
PER_LANGUAGE = 20_000
#: n-grams that a longer text counts as, so that no text alone makes a language; counts are kept in parts of 1 / UNIT.
LONG, UNIT = 10_000, 64
#: Bound of the broadcast matrix; with many languages the buckets are halved until it holds.
MATRIX_BYTES = 64 << 20
#: Code points scored at once.
BLOCK = 500_000
UNDETERMINED = "und"
#: Nats per n-gram by which a text may fit its language worse than the language's own texts do.
MOST_SURPRISE = 2.0


@dataclass(frozen=True)
class Model:
    languages: list[str]
    matrix: np.ndarray  # log probability, buckets x languages
    prior: np.ndarray
    usual: np.ndarray  # mean log probability of a language's own n-grams


def grams(text: str, buckets: int) -> np.ndarray:
    """Hashed character n-grams of the lower-cased text, with white space runs as one space."""
    points = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    mixed = np.zeros(len(points), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        mixed = (mixed[: len(points) - n + 1] * np.uint32(0x01000193)) ^ (points[n - 1 :] * np.uint32(0x9E3779B1))
        if n in ORDERS:
            out.append(((mixed ^ np.uint32(n * 0x5BD1)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - buckets.bit_length() + 1))
    return np.concatenate(out)


def parts(text: str) -> Iterator[str]:
    for i in range(0, len(text), BLOCK):
        yield text[i : i + BLOCK]


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            mine = counts.setdefault(lang, np.zeros(buckets, np.int64))
            own = sum(np.bincount(grams(part, buckets), minlength=buckets) for part in parts(text)) if text else mine * 0
            mine += np.rint(own * (UNIT * min(1.0, LONG / max(1, own.sum())))).astype(np.int64)
    for lang, mine in counts.items():
        full = np.flatnonzero(mine)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(mine[full])], ["lang", "bucket", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """The model of docs' labelled texts."""
    labelled = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(*(c for c in ("doc_id", text) if c in docs.columns)).alias("row")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1, 0)), np.zeros(0), np.zeros(0))
    buckets = BUCKETS
    while buckets * len(languages) * 4 > MATRIX_BYTES and buckets > 4096:
        buckets //= 2
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, int(min(1.0, per_language / sizes[k]) * (1 << 30)))])
    sample = labelled.where(F.pmod("row", F.lit(1 << 30)) < share[F.col("lang")]).select("lang", "text")
    rows = sample.mapInArrow(partial(_count, buckets=buckets), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((buckets, len(languages)), 0.5 * UNIT)
    place = {k: i for i, k in enumerate(languages)}
    column = [place[k] for k in rows.column("lang").to_pylist()]
    counts[rows.column("bucket").to_numpy(), column] += rows.column("n").to_numpy()
    prior = np.array([sizes[k] for k in languages], float)
    share = counts / counts.sum(0)
    return Model(languages, np.log(share).astype(np.float32), np.log(prior / prior.sum()), (share * np.log(share)).sum(0))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def score(texts: list[str | None], model: Model) -> list[tuple[str, float, float]]:
    """Language, posterior probability and surprise of each text."""
    out: list[tuple[str, float, float]] = [(UNDETERMINED, 0.0, 0.0)] * len(texts)
    waiting: list[tuple[int, np.ndarray]] = []

    def judged(total: np.ndarray, n: int) -> tuple[str, float, float]:
        best = int(total.argmax())
        return model.languages[best], float(1 / np.exp(total - total[best]).sum()), float(model.usual[best] - (total[best] - model.prior[best]) / n)

    def settle() -> None:
        if waiting:
            sizes = [len(g) for _, g in waiting]
            rows = model.matrix.take(np.concatenate([g for _, g in waiting]), axis=0)
            sums = np.add.reduceat(rows, np.cumsum([0, *sizes[:-1]]), axis=0, dtype=np.float64)
            for (i, g), x in zip(waiting, sums, strict=True):
                out[i] = judged(model.prior + x, len(g))
            waiting.clear()

    held = 0
    for i, text in enumerate(texts):
        if not text or not model.languages or not has_letter(text):
            continue
        if held and held + len(text) > BLOCK:
            settle()
            held = 0
        if len(text) > BLOCK:  # a long text is added up part by part
            total, n = model.prior, 0
            for part in parts(text):
                found = grams(part, len(model.matrix))
                total, n = total + model.matrix.take(found, axis=0).sum(0, dtype=np.float64), n + len(found)
            out[i] = judged(total, n)
            continue
        waiting.append((i, grams(text, len(model.matrix))))
        held += len(text)
    settle()
    return out


def predict(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """docs with a struct column of the predicted language, lang string, its probability, score double, and surprise."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double, surprise: double>")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = score(batch.to_pylist(), shared.value)
            yield pa.StructArray.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))], ["lang", "score", "surprise"])

    return docs.withColumn(into, identify(F.col(text)))


def held_out(doc_id: Column, modulus: int = 5) -> Column:
    """Rows that are kept from learning; false for a null id, from which nothing is learned either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 0, F.lit(False))


def identify(docs: DataFrame, least_score: float = 0.5, most_surprise: float = MOST_SURPRISE) -> DataFrame:
    """docs without those whose language is undetermined, less certain than least_score, or of which the language that
    fits best fits worse than its own texts by more than most_surprise: texts in a language that was never learned, or
    in none. Learns from docs' own labels of the rows that aren't held out."""
    learn = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    found = F.col("__language")
    fits = (found["lang"] != UNDETERMINED) & (found["score"] >= least_score) & (found["surprise"] <= most_surprise)
    return predict(docs, fit(learn), into="__language").where(fits).drop("__language")
