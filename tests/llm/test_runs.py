"""Periodic runs against a plain search of all periods."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import runs
from sparkloom.llm.queries import op13_runs
from tests.llm.docs import frame, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    """(start, length, period) of all runs, each with its smallest period."""
    out, number = {}, np.unique(w, return_inverse=True)[1] if len(w) else np.zeros(0)
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[False], number[q:] == number[:-q], [False]])
        turns = np.flatnonzero(same[1:] != same[:-1]).tolist()
        for i, j in zip(turns[::2], turns[1::2], strict=True):
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def altered(doc, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    return w


def plain_row(doc, text):
    w = altered(doc, text)
    found = plain_runs(w)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(w, found)))


def found_in(sequence):
    return [tuple(r) for r in runs.runs(np.array([*sequence, -1]), len(sequence)).tolist()]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_runs_of_few_words(sequence):
    assert found_in(sequence) == plain_runs(sequence)


def test_runs_of_long_periods():
    rng = random.Random(2)
    for _ in range(150):
        sequence = []
        while len(sequence) < 300:
            block = [rng.randrange(rng.choice([2, 50])) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 40]))]
            sequence += block * rng.choice([1, 1, 2, 4, 5, 9]) + block[: rng.randrange(len(block) + 1)]
        assert found_in(sequence) == plain_runs(sequence)


def test_a_long_text_of_one_word():
    assert found_in([0] * 200_000) == [(0, 200_000, 1)]


def test_rows_are_those_of_the_plain_search(spark):
    docs = frame(spark, [*rows(), (300, "ab " * 3000 + "end", "en", "s"), (301, "a b c d e f " * 500, None, None), (302, "x " * 6, "en", "s"), (303, "x " * 5, "en", "s"), (304, "a b " * 4, "en", "s")])
    table = docs.withColumn("periodic", docs.doc_id)
    found = runs.find(table.withColumn("text", runs.with_cycles(table.text, table.doc_id)))
    assert set(table.columns) == set(found.columns)
    got = Counter(tuple(r) for r in found.select("doc_id", *runs.summarised(found)).collect())
    assert got == Counter(plain_row(r["doc_id"], r["text"]) for r in docs.collect())
    assert runs.find(docs.limit(0)).collect() == []


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_slices_do_not_matter(spark, monkeypatch, size):
    import pyarrow as pa

    monkeypatch.setattr(runs, "SLICE", size)
    texts = pa.array([t for _, t, _, _ in rows()])
    whole = runs.of_texts(texts).to_pylist()
    assert [x for part in runs.slices(texts, size) for x in runs.of_texts(texts[part]).to_pylist()] == whole
    for text, x in zip(texts.to_pylist(), whole, strict=True):
        w = WORD.findall(text or "")
        assert [(r["start"], r["length"], r["period"]) for r in x["runs"]] == plain_runs(w) and x["n_words"] == len(w)
        assert x["collapsed"] == collapsed(w, plain_runs(w))


def test_query_over_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: tuple(r) for r in op13_runs(spark, sf_dir).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    assert len(found) == len(docs)
    assert all(found[r["doc_id"]] == plain_row(r["doc_id"], r["text"]) for r in docs)
    assert sum(r[1] > 0 for r in found.values()) > len(docs) // 50
