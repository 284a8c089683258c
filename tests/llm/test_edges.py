"""Every document operator on odd rows, on empty tables and beside columns of clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import bpe, langid, lm, mixing, near, quality, weak
from sparkloom.llm.queries import byte_bpe
from tests.llm.docs import frame, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = byte_bpe()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def counted(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_mixing(spark):
    docs = frame(spark)
    found = mixing.mixed(docs).collect()
    assert len(found) == len(rows())
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((d, len(words(t))) for d, t, *_ in rows())
    sizes = Counter()
    for _, t, _, s in rows():
        sizes[s] += len(words(t))
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, full, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in sources if s not in full]
        even = left / sum(weight[s] for s in rest)
        over = [s for s in rest if even * weight[s] > 2 * sizes[s]]
        if not over:
            target |= {s: even * weight[s] for s in rest}
            break
        for s in over:
            full.add(s)
            target[s] = 2 * sizes[s]
            left -= target[s]
    by_size = defaultdict(set)
    for s in sources:
        by_size[sizes[s]].add(round(target[s], 6))
    assert all(round(r["target"], 6) in by_size[r["source_size"]] for r in found)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    taken = Counter()
    for r in found:
        taken[(r["source_size"], r["target"])] += r["taken"]
    largest = max(len(words(t)) for _, t, *_ in rows())
    assert all(abs(n - k[1]) <= largest for k, n in taken.items())
    assert counted(mixing.mixed(docs.repartition(7)), "doc_id", "size", "taken") == Counter((r["doc_id"], r["size"], r["taken"]) for r in found)


def test_mix_repeats_rows(spark):
    docs = frame(spark)
    plan = Counter()
    for r in mixing.mixed(docs).collect():
        plan[r["doc_id"]] += r["repeats"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = Counter(r["doc_id"] for r in mixed.collect())
    assert got == +plan


def test_nested_budgets(spark):
    docs = frame(spark)
    take = {}
    for share in (0.4, 0.8):
        found = mixing.plan(docs, mixing.Scratch(spark, "test"), weights=(1,), share=share)
        take[share] = {r["doc_id"] for r in found[0].join(found[1].drop("source"), "key").where("whole > 0 or hash <= threshold").collect() if r["doc_id"] is not None}
    assert take[0.4] < take[0.8]


def brute_components(data, percent):
    sets = []
    for _, t, *_ in data:
        w = words((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(data)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    return sets, [top(i) for i in range(len(data))]


def test_near_duplicates(spark):
    data = rows()
    sets, group = brute_components(data, 85)
    least = {}
    for (d, *_), g in zip(data, group, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    want = Counter((d, len(s), least.get(g) if s else d, d is not None and d == (least.get(g) if s else d)) for (d, *_), s, g in zip(data, sets, group, strict=True))
    assert counted(near.near_duplicates(frame(spark)), "doc_id", "n_shingles", "component_id", "kept") == want


def test_deduplicate_keeps_one_of_each_group(spark):
    data = rows()
    sets, group = brute_components(data, 80)
    kept = near.deduplicate(frame(spark), 80)
    assert kept.columns == frame(spark).columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    by_group = defaultdict(set)
    for (d, t, *_), s, g in zip(data, sets, group, strict=True):
        if s:
            by_group[g].add((d, t))
    for members in by_group.values():
        assert sum(got[m] for m in members) == 1
    assert sum(got.values()) == len(by_group) + sum(not s for s in sets)


def test_bpe(spark):
    library = Tokenizer.from_file(BPE)
    docs = frame(spark)
    found = bpe.decode(bpe.encode(docs, BPE), BPE).select("doc_id", "text", "ids", "decoded").collect()
    assert len(found) == len(rows())
    for r in found:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    for r in bpe.round_trip(docs, BPE, into="tokens2").select("text", "tokens2.*").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def brute_quality(text):
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = set()
    for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)):
        if windows[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality(spark):
    found = quality.annotate(frame(spark)).collect()
    want = Counter((d, *brute_quality(t)) for d, t, *_ in rows())
    assert Counter((r["doc_id"], *(r[c] for c in quality.COUNTS), r["base_failed"]) for r in found) == want
    assert not any(r["kept"] and r["base_failed"] for r in found)
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert not kept[110] and not kept[111] and all(kept[i] for i in range(60) if i != 5)
    docs = frame(spark)
    passed = quality.filter_documents(docs)
    assert passed.columns == docs.columns and passed.count() == sum(r["kept"] for r in found)


def symbolic(per_mille, i, n_words=200):
    """A text of distinct words of five letters with symbols at a rate."""
    words_ = [f"{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k * 7 % 26)}{chr(97 + k * 11 % 26)}" for k in range(n_words)]
    return " ".join(words_) + " " + "#" * (per_mille * n_words * 5 // (1000 - per_mille))


def test_cutoffs_follow_their_group(spark, monkeypatch):
    """What is usual in one source is odd in another: sources differ in their cutoffs, which no constant can replace."""
    data = [(i, symbolic(70 + i % 20, i), "en", "code") for i in range(150)]
    data += [(1000 + i, symbolic(0 if i % 20 else 4, i), "en", "prose") for i in range(150)]
    data += [(5000, symbolic(80, 3), "en", "prose"), (5001, symbolic(80, 3), "en", "code"), (5002, symbolic(400, 3), "en", "code")]
    docs = frame(spark, data)
    measured = quality.measure(docs)
    cuts = {(r["lang_key"], r["source_key"]): r["__cut_symbols"] for r in quality.cutoffs(quality.sketch(measured, measured["lang"], measured["source"])).collect()}
    assert cuts["=en", "=code"] > 90 and cuts["=en", "=prose"] < 20
    kept = {r["doc_id"]: r["kept"] for r in quality.annotate(docs).collect()}
    assert kept[5001] and not kept[5000] and not kept[5002] and all(kept[i] for i in range(150))
    for rate in quality.LEVELS:  # sketches of parts add up
        parts = [quality.sketch(m, m["lang"], m["source"]) for m in (measured.where("doc_id % 2 = 0"), measured.where("doc_id % 2 = 1"))]
        merged = quality.cutoffs(parts[0].union(parts[1])).select("source_key", f"__cut_{rate}")
        assert sorted(merged.collect()) == sorted(quality.cutoffs(quality.sketch(measured, measured["lang"], measured["source"])).select("source_key", f"__cut_{rate}").collect())
    monkeypatch.setattr(quality, "cutoffs", lambda sketches: sketches.groupBy("lang_key", "source_key").agg(*[quality.F.lit(50).alias(f"__cut_{k}") for k in quality.RATES]))
    assert {r["doc_id"]: r["kept"] for r in quality.annotate(docs).collect()} != kept


def test_few_are_judged_by_a_texts_length(spark):
    """By chance a text of a rate below one in a thousand has some; what is too many for a short one isn't for a long."""
    data = [(i, symbolic(0, i, 60), "en", "a") for i in range(120)]
    data += [(500, symbolic(0, 5, 60) + "#" * 4, "en", "a"), (501, symbolic(0, 5, 60) + "#" * 6, "en", "a"), (502, symbolic(0, 5, 600) + "#" * 6, "en", "a"), (503, symbolic(0, 5, 600) + "#" * 14, "en", "a")]
    kept = {r["doc_id"]: r["kept"] for r in quality.annotate(frame(spark, data)).collect()}
    assert [kept[i] for i in (500, 501, 502, 503)] == [True, False, True, False]


def test_symbols_that_most_texts_of_either_source_lack(spark):
    """Rare in one source, usual in a part of another: zeros in most texts of both don't make their cutoffs alike."""
    data = [(i, symbolic(0 if i % 10 else 3, i), "en", "prose") for i in range(200)] + [(1000 + i, symbolic(0 if i % 5 < 3 else 60 + i % 9, i), "en", "code") for i in range(200)]
    data += [(5000, symbolic(50, 3), "en", "prose"), (5001, symbolic(50, 3), "en", "code")]
    kept = {r["doc_id"]: r["kept"] for r in quality.annotate(frame(spark, data)).collect()}
    assert not kept[5000] and kept[5001] and all(k for i, k in kept.items() if i < 5000)


def test_small_groups_lean_on_wider_ones(spark):
    """A source of a few texts is judged by its language's sketch, one of many by its own; between them the own texts
    count for what they are, without a size at which this changes."""
    cuts = {}
    for n in (1, 4, 60, 200):
        data = [(i, symbolic(0, i), "en", "prose") for i in range(300)] + [(1000 + i, symbolic(100, i), "en", "code") for i in range(n)]
        measured = quality.measure(frame(spark, data))
        cuts[n] = {r["source_key"]: r["__cut_symbols"] for r in quality.cutoffs(quality.sketch(measured, measured["lang"], measured["source"])).collect()}["=code"]
    assert cuts[1] == 0 and cuts[4] == 0 and cuts[60] > 80 and cuts[200] > 80


def test_language(spark):
    docs = frame(spark)
    model = langid.fit(docs)
    assert model.languages == ["de", "en"]
    found = {(r["doc_id"], r["text"]): r["language"] for r in langid.predict(docs, model).collect()}
    for d, t, lang, _ in rows():
        p = found[d, t]
        assert 0 <= p["score"] <= 1
        if not any(c.isalpha() for c in t or ""):
            assert (p["lang"], p["score"]) == ("und", 0)
        elif len(words(t)) >= 50 and d is not None and d < 60 and lang and d != 5:
            assert p["lang"] == lang
    kept = langid.identify(docs)
    assert kept.columns == docs.columns
    assert not {103, 104, 105, 108} & {r["doc_id"] for r in kept.collect()}


def test_language_model(spark):
    data = rows()
    tokens = [words((t or "").translate(LOWER)) + ["\n"] for _, t, *_ in data]
    learn = [d is not None and crc(d) % 7 != 2 for d, *_ in data]
    c = Counter(w for t, ok in zip(tokens, learn, strict=True) if ok for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for (d, *_), t in zip(data, tokens, strict=True):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        want[d, d is not None and crc(d) % 7 == 2, len(t), sum(c[w] > 0 for w in t), n, round(base, 6)] += 1
    found = lm.score(frame(spark)).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == want
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def brute_interpolation(data):
    """The score of each row of data by plain deleted interpolation: estimates, held-out counts and weights."""
    texts = [words((t or "").translate(LOWER)) + ["\n"] for _, t, *_ in data]
    learn = [d is not None and crc(d) % 7 != 2 for d, *_ in data]
    tune = [d is not None and crc(d) % 7 == 3 for d, *_ in data]
    pairs_of = lambda t: list(zip(["\n", *t[:-1]], t, strict=True))
    one, two = Counter(), Counter()
    for t, ok in zip(texts, learn, strict=True):
        if ok:
            one.update(t)
            two.update(pairs_of(t))
    n, v = sum(one.values()), len(one)
    kind = lambda c: min(int(math.log2(c + 1)), lm.BUCKETS - 1)
    step = lambda f: 1 + int(-math.log2(f) * lm.STEPS) if f > 0 else 0
    cells = defaultdict(lambda: [0, 0.0, 0.0])
    for t, ok in zip(texts, tune, strict=True):
        if not ok:
            continue
        mine, ours = Counter(t), Counter(pairs_of(t))
        for a, b in pairs_of(t):
            context = max(one[a] - mine[a], 0)
            f2 = max(two[a, b] - ours[a, b], 0) / context if context else 0.0
            f1 = max(one[b] - mine[b], 0) / max(n - len(t), 1)
            cell = cells[kind(context), step(f2), step(f1)]
            for i, x in enumerate((1, f2, f1)):
                cell[i] += x

    def learned(chosen):
        mix = [1 / 3] * 3
        for _ in range(lm.ROUNDS):
            share = [1e-3] * 3
            for times, sum2, sum1 in chosen:
                part = [mix[0] * sum2 / times, mix[1] * sum1 / times, mix[2] / (v + 1)]
                share = [s + times * p / sum(part) for s, p in zip(share, part, strict=True)]
            mix = [s / sum(share) for s in share]
        return mix

    everything = learned(list(cells.values()))
    mixes = [learned(own) if (own := [c for k, c in cells.items() if k[0] == b]) else everything for b in range(lm.BUCKETS)]
    mixes[0] = [0, mixes[0][1] + mixes[0][0] / 2, mixes[0][2] + mixes[0][0] / 2]
    out = []
    for t in texts:
        total = 0.0
        for a, b in pairs_of(t):
            w = mixes[kind(one[a])]
            total += math.log10(w[0] * two[a, b] / max(one[a], 1) + w[1] * one[b] / max(n, 1) + w[2] / (v + 1))
        out.append(total)
    return out


@pytest.mark.parametrize("table", ["odd rows", "documents"])
def test_language_model_scores_are_those_of_plain_interpolation(spark, sf_dir, table):
    if table == "odd rows":
        data, docs = rows(), frame(spark)
    else:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
        data = [tuple(r) for r in docs.collect()]
    want = sorted((len(words(t)) + 1, x) for (_, t, *_), x in zip(data, brute_interpolation(data), strict=True))
    got = sorted((r["n_tokens"], r["score"]) for r in lm.score(docs).collect())
    assert len(got) == len(want)
    assert all(g[0] == w[0] and math.isclose(g[1], w[1], rel_tol=1e-9, abs_tol=1e-9) for g, w in zip(got, want, strict=True))


def test_frequent_words_are_not_asked_for(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 20_000)
    want = sorted((r["n_tokens"], r["base_score"], r["score"]) for r in lm.score(frame(spark)).collect())
    monkeypatch.setattr(lm, "COMMON", 0)
    got = sorted((r["n_tokens"], r["base_score"], r["score"]) for r in lm.score(frame(spark)).collect())
    assert all(math.isclose(x, y, rel_tol=1e-9) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))


def test_language_model_in_small_blocks_agrees(spark, monkeypatch):
    want = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.score(frame(spark)).collect()}
    monkeypatch.setattr(lm, "BLOCK", 20_000)
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.score(frame(spark)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


@pytest.mark.parametrize("run", [mixing.mixed, mixing.mix, near.near_duplicates, near.deduplicate, quality.annotate, quality.filter_documents, langid.identify, lm.score, weak.classify, lambda d: bpe.round_trip(d, BPE, into="x")])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).collect() == []


def test_only_wordless_rows(spark):
    data = [(1, None, None, None), (2, "", "en", "a"), (None, " ", None, "a")]
    assert sum(r["taken"] for r in mixing.mixed(frame(spark, data)).collect()) == 0
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in near.near_duplicates(frame(spark, data)).collect()} == {(1, 1, True), (2, 2, True), (None, None, False)}
    assert not any(r["kept"] for r in quality.annotate(frame(spark, data)).collect())
    assert langid.identify(frame(spark, data)).count() == 0
    assert all(r["n_tokens"] == 1 for r in lm.score(frame(spark, data)).collect())


def test_weak_labels(spark):
    found = weak.classify(frame(spark)).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(d for d, *_ in rows())
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert all(kept[i] for i in range(60) if i != 5) and not any(kept[i] for i in (103, 104, 105, 111))
    assert all(0 <= r["posterior"] <= 1 and 0 <= r["score"] <= 1 and set(r["votes"]) <= set("012") and len(r["votes"]) == len(weak.labellers()) for r in found)
    assert len({(r["votes"], r["score"]) for r in found if r["doc_id"] == 2}) == 1


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    docs = frame(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
