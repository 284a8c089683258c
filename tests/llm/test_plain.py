"""Operators that SQL can't express against plain versions of them, written without numpy's or Spark's help."""

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from sparkloom.llm import langid, weak
from sparkloom.llm.queries import op2_weak_labels, op10_langid
from tests.llm.docs import frame, rows
from tests.llm.test_edges import LOWER, brute_quality, crc, words

M32 = (1 << 32) - 1


def plain_grams(text):
    points = [ord(c) for c in f" {' '.join(text.lower().split())} "]
    shift = 32 - (langid.BUCKETS.bit_length() - 1)
    for n in langid.ORDERS:
        for i in range(len(points) - n + 1):
            h = 0
            for p in points[i : i + n]:
                h = ((h * 0x01000193) & M32) ^ ((p * 0x9E3779B1) & M32)
            yield ((((h ^ (n * 0x5BD1)) & M32) * 0x85EBCA6B) & M32) >> shift


def plain_language(data, learns):
    """(language, probability, surprise) of each (doc_id, text, lang), learned from the rows that `learns` holds for."""
    counts, texts = defaultdict(Counter), Counter()
    for d, t, lang in data:
        if learns(d) and t is not None and lang is not None:
            texts[lang] += 1
            own = Counter(plain_grams(t)) if t else Counter()
            scale = langid.UNIT * min(1.0, langid.LONG / max(1, sum(own.values())))
            for g, n in own.items():
                counts[lang][g] += round(n * scale)
    total = {k: sum(counts[k].values()) + 0.5 * langid.UNIT * langid.BUCKETS for k in texts}
    log = lambda k, g: math.log((counts[k][g] + 0.5 * langid.UNIT) / total[k])
    empty = {k: langid.BUCKETS - len(counts[k]) for k in texts}
    usual = {k: sum(math.exp(log(k, g)) * log(k, g) for g in counts[k]) + empty[k] * math.exp(log(k, None)) * log(k, None) for k in texts}
    out = []
    for _, t, _ in data:
        if not t or not texts or not any(c.isalpha() for c in t):
            out.append(("und", 0.0, 0.0))
            continue
        own = Counter(plain_grams(t))
        fit = {k: sum(n * log(k, g) for g, n in own.items()) for k in texts}
        odds = {k: fit[k] + math.log(texts[k] / sum(texts.values())) for k in texts}
        best = max(sorted(odds), key=odds.get)
        out.append((best, 1 / sum(math.exp(odds[k] - odds[best]) for k in odds), usual[best] - fit[best] / sum(own.values())))
    return out


def close(got, want):
    return got[0] == want[0] and all(math.isclose(g, w, rel_tol=1e-3, abs_tol=1e-3) for g, w in zip(got[1:], want[1:], strict=True))


def test_language_is_that_of_plain_naive_bayes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    want = {d: x for (d, *_), x in zip(data, plain_language(data, lambda d: crc(d) % 5 != 0), strict=True)}
    for r in op10_langid(spark, sf_dir).collect():
        assert close((r["lang_pred"], r["score"]), want[r["doc_id"]][:2]) and r["held_out"] == (crc(r["doc_id"]) % 5 == 0)


def test_language_of_odd_rows_is_that_of_plain_naive_bayes(spark):
    data = [(d, t, lang) for d, t, lang, _ in rows() if t is None or len(t) < 20_000]
    want = sorted(((d is None, d or 0, t or ""), x) for (d, t, _), x in zip(data, plain_language(data, lambda d: True), strict=True))
    docs = frame(spark, [(*r, "s") for r in data])
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""), tuple(r["language"])) for r in langid.predict(docs, langid.fit(docs)).collect())
    assert len(got) == len(want) and all(g[0] == w[0] and close(g[1], w[1]) for g, w in zip(got, want, strict=True))


def test_texts_in_no_learned_language_are_rejected(spark):
    odd = {500: "Съешь же ещё этих мягких французских булок да выпей чаю " * 8, 501: "qzx wvk jjq xkz vvq zzkx " * 20, 502: "if (x) { return y_1[i++]; } else { z = 0x1f; } " * 10}
    docs = frame(spark, rows() + [(d, t, "en", "s") for d, t in odd.items() if d != 501] + [(501, odd[501], None, "s")])
    learn = frame(spark)
    found = {r["doc_id"]: r["language"] for r in langid.predict(docs, langid.fit(learn)).collect()}
    assert all(found[d]["surprise"] > langid.MOST_SURPRISE for d in odd)
    assert all(found[i]["surprise"] < 1 for i in range(60) if i != 5)


def plain_counts(text):
    """What weak labellers count, from regular expressions alone."""
    t = text or ""
    n, chars, symbols, dup, repeated, _ = brute_quality(text)
    narrow = [c for c in t if ord(c) < 256]
    wide = sum(ord(c) >= 256 for c in t)  # counts as a small letter
    letters = sum(c.isalpha() for c in narrow) + wide
    upper = sum(c.isalpha() and c != c.lower() for c in narrow)
    kind = lambda c: "a" if ord(c) >= 256 or c.isalpha() else "0" if c.isdigit() else " " if c.isspace() else "."
    shape = "".join(kind(c) for c in f" {t} ")
    marked = len(re.findall(r"(?=\.\. | \. )", shape))
    stops = sum(a in ".!?" and kind(b) == " " for a, b in zip(f" {t} ", f"{t} ", strict=False))
    mine = words(t.translate(LOWER))
    lines = [x for x in t.split("\n") if words(x)]
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeated, "n_lines": len(lines), "n_distinct": len(set(words(t))), "n_letters": letters, "n_upper": upper, "n_marked": marked, "n_stops": stops, "n_frequent": sum(w in weak.FREQUENT for w in mine)}


def plain_votes(c):
    n, chars, lines = c["n_words"], c["word_chars"], c["n_lines"]
    rules = [
        (n >= 80, n < 5),
        (c["n_symbols"] * 100 <= chars, c["n_symbols"] * 100 > chars * 5),
        (c["n_marked"] * 20 <= n, c["n_marked"] * 20 > n * 3),
        (c["n_letters"] * 100 >= chars * 90, c["n_letters"] * 100 < chars * 80),
        (n >= 30 and c["n_repeat_words"] * 10 <= n * 2, c["n_repeat_words"] * 10 > n * 4),
        (n >= 30 and c["n_distinct"] * 10 >= n * 5, n >= 60 and c["n_distinct"] * 10 < n * 3),
        (lines >= 3 and c["n_dup_lines"] * 10 <= lines, c["n_dup_lines"] * 10 > lines * 4),
        (n >= 20 and c["n_upper"] * 10 <= chars, c["n_upper"] * 10 > chars * 3),
        (n >= 20 and n * 3 <= chars <= n * 7, chars > n * 12 or chars < n * 2),
        (c["n_frequent"] * 100 >= n * 8, n >= 30 and c["n_frequent"] * 100 < n),
        (n >= 30 and c["n_stops"] * 60 >= n, n >= 60 and c["n_stops"] == 0),
    ]
    return "".join("0" if bad else "2" if good else "1" for good, bad in rules)


def plain_posteriors(votes):
    """Of each row of votes, by expectation-maximisation over rows."""
    k = len(votes[0])
    good = [0.95 if (s := sum(int(v) - 1 for v in row)) > 1 else 0.05 if s < 1 else 0.5 for row in votes]
    for _ in range(weak.ROUNDS):
        share = min(max(sum(good) / len(good), 1e-3), 1 - 1e-3)
        table = [[[1.0, 1.0] for _ in range(2)] for _ in range(k)]  # labeller, class, vote
        for row, q in zip(votes, good, strict=True):
            for i, v in enumerate(row):
                if v != "1":
                    table[i][1][v == "2"] += q
                    table[i][0][v == "2"] += 1 - q
        p = [[[x / sum(pair) for x in pair] for pair in both] for both in table]
        odds = [math.log(share / (1 - share)) + sum(math.log(p[i][1][v == "2"] / p[i][0][v == "2"]) for i, v in enumerate(row) if v != "1") for row in votes]
        good = [1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for o in odds]
    return good


@pytest.mark.parametrize("table", ["odd rows", "documents"])
def test_votes_and_posteriors_are_those_of_plain_labellers(spark, sf_dir, table):
    if table == "odd rows":
        data, found = [(d, t) for d, t, *_ in rows()], weak.classify(frame(spark))
    else:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        data, found = [(r["doc_id"], r["text"]) for r in docs.collect()], op2_weak_labels(spark, sf_dir)
    votes = [plain_votes(plain_counts(t)) for _, t in data]
    want = sorted((d is None, d or 0, v, round(p, 6)) for (d, _), v, p in zip(data, votes, plain_posteriors(votes), strict=True))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["votes"], round(r["posterior"], 6)) for r in found.collect())
    assert [w[:3] for w in want] == [g[:3] for g in got]
    assert all(math.isclose(g[3], w[3], abs_tol=2e-6) for g, w in zip(got, want, strict=True))


def plain_features(text):
    shape = lambda c: int(weak.CLASSES[ord(c)]) if ord(c) < 256 else 0
    padded = f" {text or ''} "
    shapes = Counter(shape(a) * 256 + shape(b) * 16 + shape(c) for a, b, c in zip(padded, padded[1:], padded[2:], strict=False))
    of_word = {w: int(weak.pd.util.hash_array(weak.np.array([w], object), categorize=False)[0]) for w in set(words((text or "").translate(LOWER)))}
    hashed = Counter(weak.SHAPES + of_word[w] % weak.WORDS for w in words((text or "").translate(LOWER)))
    out = {weak.DIMENSIONS - 1: 1.0}
    for part in (shapes, hashed):
        for k, n in part.items():
            out[k] = math.sqrt(n / (2 * sum(part.values())))
    return out


def test_features_are_those_of_a_plain_count(monkeypatch):
    texts = [t for _, t, *_ in rows()]
    want = [plain_features(t) for t in texts]
    whole = weak.features_of(pa.array(texts, pa.string()))
    for got, w in zip(whole, want, strict=True):
        assert got[0].tolist() == sorted(w) and all(math.isclose(v, w[k], abs_tol=1e-3) for k, v in zip(got[0].tolist(), got[1].tolist(), strict=True))
    monkeypatch.setattr(weak, "BLOCK", 100)
    for got, again in zip(whole, weak.features_of(pa.array(texts, pa.string())), strict=True):
        assert got[0].tolist() == again[0].tolist() and got[1].tolist() == again[1].tolist() and got[2] == again[2]


def test_scores_are_those_of_plain_gradients(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = {r["doc_id"]: r for r in weak.classify(docs).collect()}
    data = [(r["doc_id"], plain_features(r["text"])) for r in docs.collect() if r["text"]]
    weights, momentum, scale = (defaultdict(float) for _ in range(3))
    sigmoid = lambda f: 1 / (1 + math.exp(-sum(weights[k] * v for k, v in f.items())))
    for step in range(1, weak.STEPS + 1):
        gradient = defaultdict(float)
        for d, f in data:
            off = (sigmoid(f) - found[d]["posterior"]) / len(data)
            for k, v in f.items():
                gradient[k] += off * v
        for k in gradient:
            g = gradient[k] + 1e-5 * weights[k]
            momentum[k], scale[k] = 0.8 * momentum[k] + 0.2 * g, 0.95 * scale[k] + 0.05 * g * g
            weights[k] -= 0.5 * (momentum[k] / (1 - 0.8**step)) / (math.sqrt(scale[k] / (1 - 0.95**step)) + 1e-6) * min(1.0, 20 / (20 + step))
    assert all(abs(found[d]["score"] - sigmoid(f)) < 0.02 for d, f in data)
