"""Personal data: base patterns against plain regular expressions, beliefs against sums over all labellings."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import pii
from sparkloom.llm.queries import op11_private
from tests.llm.docs import frame, rows

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_base(text):
    n = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(1, *m.span()) for m in EMAIL.finditer(text)]
    out += [(2, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(3, *m.span()) for m in CARD.finditer(text) if 13 <= len(n(m)) <= 19 and passes(n(m))]
    return out + [(4, *m.span()) for m in PHONE.finditer(text) if 9 <= len(n(m)) <= 15]


def plain_row(doc, text):
    found = plain_base(text or "")
    lines = ",".join(f"{pii.KINDS[k - 1]}:{s}:{e}" for k, s, e in found)
    return (doc, *[sum(k == x for x, _, _ in found) for k in range(1, 5)], hashlib.sha256(lines.encode()).hexdigest())


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a@.-+ 1405(9é", max_size=60))
def test_base_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


def test_base_patterns_on_likely_texts():
    rng = random.Random(4)
    for _ in range(3000):
        parts = [rng.choice(["a.b@c.d", "@", "x@y", "+1 (487) 555-7209", "4111 1111 1111 1111", "4111-1111", "10.2.3.4", "300.1.1.1", "1.2.3.4.5", "007", ".", "-", " ", "+", "%", "\n", "é", "0000"]) for _ in range(rng.randrange(12))]
        text = "".join(parts)
        assert pii.base_spans(text) == plain_base(text)


def some(chain=None):
    return pii.Potentials(np.zeros((2, pii.BESIDE, 5)), np.zeros((5, 5)) if chain is None else chain, np.log(400), np.log(400))


def every_labelling(own, edges, tables):
    """Beliefs by adding up all labellings."""
    out = np.zeros_like(own)
    for labels in itertools.product(range(own.shape[1]), repeat=len(own)):
        score = sum(own[i, x] for i, x in enumerate(labels)) + sum(tables[t][labels[a], labels[b]] for a, b, t in edges)
        for i, x in enumerate(labels):
            out[i, x] += np.exp(score)
    return out / out.sum(1, keepdims=True)


def test_beliefs_are_exact_without_loops():
    rng = np.random.default_rng(1)
    for n in (1, 2, 4, 6):
        own, tables = rng.normal(size=(n, 3)), rng.normal(size=(3, 3, 3))
        edges = np.array([(int(rng.integers(i)), i, int(rng.integers(3))) for i in range(1, n)], np.int64).reshape(-1, 3)
        old, pii.STATES = pii.STATES, 3
        try:
            assert np.allclose(pii.beliefs(own, edges, tables), every_labelling(own, edges, tables), atol=1e-3)
        finally:
            pii.STATES = old


@pytest.mark.parametrize("text", ["+1 (487) 555-7209 or 487-555-7209", "a@b.c a (at) b.c", "host 10.2.3.4 x 10[.]2[.]3[.]4", "only 487-555-7209", "4111 1111 1111 1111, 4111 1111 1111 1112", "+1 (487) 555-7209 or 555-0000"])
def test_labels_with_loops_are_those_of_all_labellings(text):
    doc = pii._of_text(text)
    p = some(np.random.default_rng(2).normal(size=(5, 5)) * 0.2)
    own, edges = pii.graph([doc], p)
    exact = every_labelling(own, edges, p.tables())
    assert (pii.beliefs(own, edges, p.tables())[: len(doc)].argmax(1) == exact[: len(doc)].argmax(1)).all()


FOUND = {
    "Call +1 (487) 555-7209. Or 487-555-7209, 1 487 555 7209, 4875557209, 555-7209.": ["+1 (487) 555-7209", "487-555-7209", "1 487 555 7209", "4875557209", "555-7209"],
    "card 4111 1111 1111 1111 and 4111.1111.1111.1111, once 4111 1111 1111 1112": ["4111 1111 1111 1111", "4111.1111.1111.1111", "4111 1111 1111 1112"],
    "x 7536784127813050 4845168114407329 y 4845168114407329": ["4845168114407329", "4845168114407329"],
    "Ann.Lee@mail4.example.com: ann.lee at mail4 dot example dot com, ann.lee [at] mail4.example.com": ["Ann.Lee@mail4.example.com", "ann.lee at mail4 dot example dot com", "ann.lee [at] mail4.example.com"],
    "host 10.20.30.40 is 10[.]20[.]30[.]40 or 10-20-30-40": ["10.20.30.40", "10[.]20[.]30[.]40", "10-20-30-40"],
}
CLEAN = ["only 487-555-7209 here", "order 2669109448945251 twice 2669109448945251", "2020-10-12 12:30:00", "look at the door dot dot", "1.2.3 and 10-20-30-40", "sum 1000000 2000000 3000000", "", None]


def test_written_otherwise_and_clean_texts():
    for text, want in FOUND.items():
        spans = pii.label([pii._of_text(text)], some())[0]
        assert [text[s["start"] : s["end"]] for s in sorted(spans, key=lambda s: s["start"])] == want
    assert pii.label([pii._of_text(t) for t in CLEAN], some()) == [[]] * len(CLEAN)


@pytest.mark.parametrize("text", ["1" * 300_000, "1 " * 150_000, "+1" * 100_000, "a@" * 100_000, "a" * 300_000 + "@b.c", "1.2." * 80_000, "10.0.0.1 " * 3000, "+1 487 555 7209, " * 3000, " at " * 60_000, "(" * 200_000, "1-" * 150_000 + "x"])
def test_long_texts_take_linear_time(text):
    began = time.perf_counter()
    assert pii.label([pii._of_text(text)], some())
    assert time.perf_counter() - began < 20


def test_odd_rows(spark):
    data = [*rows(), *[(500 + i, t, None, "s") for i, t in enumerate([*FOUND, *CLEAN])], (None, next(iter(FOUND)), "en", None), (None, next(iter(FOUND)), "en", None)]
    table = frame(spark, data).selectExpr("*", "doc_id as spans", "1 as mentions")
    found = pii.find(table)
    assert set(found.columns) == set(table.columns) - {"text"} and pii.find(table.limit(0)).collect() == []
    base = lambda df: Counter(tuple(r) for r in df.select("doc_id", *pii.summarised()[:-1]).collect())
    assert base(found) == Counter(plain_row(r[0], r[1]) for r in data)
    spans = {r["doc_id"]: r["spans"] for r in found.where("doc_id >= 500").collect()}
    for i, (text, want) in enumerate(FOUND.items()):
        assert [text[s["start"] : s["end"]] for s in sorted(spans[500 + i], key=lambda s: s["start"])] == want
    assert not any(spans[500 + len(FOUND) + i] for i in range(len(CLEAN)))
    again = {r["doc_id"]: r["spans"] for r in pii.find(table.repartition(11)).where("doc_id >= 500").collect()}
    assert again == spans


def test_query_over_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = op11_private(spark, sf_dir).collect()
    assert Counter(tuple(r)[:-1] for r in found) == Counter(plain_row(r["doc_id"], r["text"]) for r in docs)
    assert sum(bool(r["spans"]) for r in found) > 5
    for r in found:
        kinds = [(pii.KINDS.index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]
        assert kinds == sorted(kinds) and len(kinds) >= sum(r[f"n_{k}"] for k in pii.KINDS)
