"""The parts of the operators that need no Spark, and accuracy on held-out documents."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import bpe, lm, near, weak
from sparkloom.llm.oracle import oracle_sql
from sparkloom.llm.queries import byte_bpe, op9_lm, op10_langid, queries

BPE = byte_bpe()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_bpe_is_that_of_the_library(text):
    library = _library()
    flat, ends = bpe.vocabulary(BPE).encode([text, text])
    ids = library.encode(text, add_special_tokens=False).ids
    assert flat[: ends[1]].tolist() == flat[ends[1] :].tolist() == ids
    assert bpe.vocabulary(BPE).decode(ids) == library.decode(ids, skip_special_tokens=False)


def _library(cache=[]):  # noqa: B006
    if not cache:
        cache.append(Tokenizer.from_file(BPE))
    return cache[0]


def test_bpe_merges_alike_in_both_ways():
    rng = random.Random(4)
    model = bpe.ByteBpe(BPE)
    words = ["".join(rng.choice("aeinrstéß ") for _ in range(rng.randint(1, 90))).encode() for _ in range(400)]
    assert model.merge(words) == [model.exact(w) for w in words]
    flat, owner = model.greedy(words)
    assert [b"".join(model.bytes[i] for i in flat[owner == k]) for k in range(len(words))] == words


def test_bpe_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    model = bpe.ByteBpe(BPE)
    texts = ["one two three four", "five six seven eight", "one two"]
    for t in texts:
        assert model.encode([t])[0].tolist() == _library().encode(t, add_special_tokens=False).ids


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packing(values):
    keys = np.array(sorted(set(values)), np.uint64)
    assert (lm.unpack_sorted(lm.pack_sorted(keys)) == keys).all()
    assert (lm.unpack(lm.pack(np.array(values, np.uint64))) == np.array(values, np.uint64)).all()


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_sketches_let_similar_sets_pass(percent):
    rng = np.random.default_rng(7)
    rows = near.rows_of(percent)
    met = passed = 0
    for _ in range(150):
        n = 200
        shared = int(np.ceil(2 * n * percent / (100 + percent)))
        pool = rng.integers(0, 1 << 63, 3 * n).astype(np.uint64)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:shared], pool[n : 2 * n - shared]]))
        x, y = near.samples(a), near.samples(b)
        met += bool(set(near.bands(x, rows)) & set(near.bands(y, rows)))
        differing = sum(int(v).bit_count() for v in (near.sketch(x) ^ near.sketch(y)).view(np.uint64))
        passed += differing <= near.most_bits(percent)
    assert met == passed == 150
    far = [near.sketch(near.samples(rng.integers(0, 1 << 63, 300).astype(np.uint64))) for _ in range(40)]
    assert all(sum(int(v).bit_count() for v in (p ^ q).view(np.uint64)) > near.most_bits(percent) for p, q in zip(far, far[1:], strict=False))


def test_blocks_join_across_components_alone():
    sets = [np.arange(100), np.arange(5, 100), np.arange(1000, 1100), np.arange(1001, 1100), np.arange(0, 100, 2)]
    table = pa.table({"node": [1, 2, 3, 4, 5], "of": [1, 2, 3, 3, 5], "shingles": pa.array(sets, pa.list_(pa.int64()))})
    assert near._joined(table, 85).to_pylist() == [{"a": 1, "b": 2}]
    sketches = [near.sketch(near.samples(near.mixed(s.astype(np.uint64), s.astype(np.uint64)))) for s in sets]
    block = pa.table({"key": [7] * 5, "i": [0] * 5, "j": [1] * 5, "node": [1, 2, 3, 4, 5], "of": [1, 2, 3, 3, 5], "sketch": pa.array(sketches, pa.list_(pa.int64()))})
    assert near._near(block, 85).column("node").to_pylist() == [1, 2]


def test_a_crowded_bucket_is_tested_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "SMALL", 2)
    monkeypatch.setattr(near, "SIDE", 3)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(60):
        w = base.copy()
        for _ in range(rng.randint(1, 7)):
            w[rng.randrange(150)] = f"x{rng.random()}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for t in texts]
    root = list(range(60))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert {r["doc_id"]: r["component_id"] for r in near.near_duplicates(df).collect()} == {i: top(i) for i in range(60)}


def test_links_whose_only_band_is_crowded(spark, monkeypatch):
    for name, value in {"SMALL": 2, "SIDE": 5}.items():
        monkeypatch.setattr(near, name, value)
    monkeypatch.setattr(near, "rows_of", lambda percent: 97)  # a single band
    rng = random.Random(5)
    base = [f"w{i}" for i in range(1200)]

    def changed(words):
        out = words.copy()
        out[rng.randrange(10, 1190)] = f"x{rng.random()}"
        return out

    docs = [changed(base) for _ in range(50)]
    docs += [changed(d) for d in docs[:20]]
    texts = [" ".join(d) for d in docs]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(s.tolist()) for s in near.sets_of(pa.array(texts))]
    key = [int(near.bands(near.samples(s), 97)[0]) for s in near.sets_of(pa.array(texts))]
    group = list(range(len(texts)))
    links = [(j, i) for i in range(len(texts)) for j in range(i) if key[i] == key[j] and 100 * len(sets[i] & sets[j]) >= 99 * len(sets[i] | sets[j])]
    for j, i in links:
        low, high = sorted((group[i], group[j]))
        group = [low if g == high else g for g in group]
    assert sum(key.count(key[i]) > 2 * near.SIDE for _, i in links) > 3
    assert {r["doc_id"]: r["component_id"] for r in near.near_duplicates(df, 99).collect()} == dict(enumerate(group))


def test_copies_of_a_template_fall_apart_into_small_groups(spark, monkeypatch):
    """Texts that share three of four shingles meet in one bucket, but none of them is compared with all others."""
    monkeypatch.setattr(near, "rows_of", lambda percent: 2)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base + [f"x{rng.random()}" for _ in range(110)]) for _ in range(150)]
    texts += [t.rsplit(" ", 1)[0] + " changed" for t in texts[:5]]  # a near copy of each
    seen = []
    joined = near.Linker.divided
    monkeypatch.setattr(near.Linker, "divided", lambda self, crowds: seen.append(joined(self, crowds)) or seen[-1])
    found = near.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: i - 150 if i >= 150 else i for i in range(155)}
    assert seen and max((r["members"] for r in seen[0].collect()), default=0) <= near.SMALL


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    found = op10_langid(spark, sf_dir).where("held_out").join(docs, "doc_id").where("length(text) > 100").collect()
    assert len(found) > 20 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found)


def test_language_model_beats_its_base_on_held_out_documents(spark, sf_dir):
    r = op9_lm(spark, sf_dir).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b", "sum(n_tokens) AS n").first()
    assert r["s"] / r["n"] > r["b"] / r["n"] + 0.1


def test_agreement_finds_accuracies():
    rng = np.random.default_rng(8)
    k, right, n = len(weak.labellers()), np.linspace(0.65, 0.95, len(weak.labellers())), 20_000
    truth = rng.random(n) < 0.8
    vote = np.where(rng.random((n, k)) < right, truth[:, None], ~truth[:, None]) * 2
    vote[rng.random((n, k)) < 0.3] = 1
    patterns = pd.Series((vote * 3 ** np.arange(k)).sum(1)).value_counts().rename_axis("pattern").reset_index(name="n")
    found = weak.agreement(patterns)
    assert abs(found.good - 0.8) < 0.02 and np.abs(found.accuracy() - right).max() < 0.03
    posterior = np.array([found.posterior[p] for p in (vote * 3 ** np.arange(k)).sum(1)])
    assert ((posterior > 0.5) == truth).mean() > 0.97
    assert weak.agreement(patterns.iloc[:0]).posterior == {}


def test_weak_labels_find_labelled_quality(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = queries()["op2_weak_labels"](spark, sf_dir).join(labels, "doc_id").collect()
    good, bad = ([r["kept"] for r in found if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_names():
    names = list(queries())
    assert [n for n in names if n.startswith("op")] == names and set(oracle_sql()) <= set(names)
    assert [n.split("_")[0] for n in names] == ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13"]
    assert len(corpus_pipeline.STAGES) == 5
