"""The pipeline's stages one after the other against a brute-force version of each on the same input."""

import math
from collections import Counter, defaultdict

from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import langid, quality
from tests.llm.docs import SCHEMA, frame
from tests.llm.test_edges import BPE, brute_components, brute_quality, crc, words
from tests.llm.test_plain import plain_language


def brute_kept(data):
    """The rows that the quality rules keep."""
    measured = []
    for d, t, lang, source in data:
        n, chars, symbols, dup, repeated, failed = brute_quality(t)
        lines = sum(bool(words(x)) for x in (t or "").split("\n"))
        share = lambda a, b: a * 1000 // b if b else 0
        counts = {"symbols": symbols, "lines": dup, "repeats": repeated}
        measured.append(((d, t), lang, source, failed, {"symbols": share(symbols, chars), "lines": share(dup, lines), "repeats": share(repeated, n)}, counts, {"symbols": chars, "lines": lines, "repeats": n}))

    def down(v):
        step = max(0, v.bit_length() - 5)
        return v >> step << step

    def cutoff(rate, lang, source):
        passing = [(m[1], m[2], down(m[4][rate])) for m in measured if not m[3]]
        groups = [[v for *_, v in passing], [v for a, _, v in passing if a == lang], [v for a, b, v in passing if (a, b) == (lang, source)]]
        everywhere, of_lang, own = map(Counter, groups)
        wider = lambda v: (of_lang[v] + quality.PRIOR * everywhere[v] / len(groups[0])) / (len(groups[1]) + quality.PRIOR)
        weight = {v: int(quality.UNIT * (own[v] + quality.PRIOR * wider(v))) for v in sorted(everywhere)}
        at = lambda q: next(v for v in weight if sum(w for x, w in weight.items() if x <= v) * 100 >= sum(weight.values()) * q)
        return at(quality.LEVELS[rate]) + quality.SPREAD * (at(quality.LEVELS[rate]) - at(50))

    most = lambda r, m: (math.sqrt(m[6][r] * (cutoff(r, m[1], m[2]) + 1) / 1000) + quality.SPREAD / 2) ** 2
    fine = lambda m: all(k <= most(r, m) for r, k in m[5].items())
    return Counter(m[0] for m in measured if not m[3] and fine(m))


def test_stages_are_their_brute_force_versions(spark, sf_dir):
    (_, rules), (_, language), (_, dedup), (_, mixture), (_, tokens) = corpus_pipeline.STAGES
    docs = frame(spark)
    plain = lambda df: [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]
    again = lambda rows: spark.createDataFrame([(*r, 0, 0, False, 0, "", "") for r in rows], SCHEMA)
    keys = lambda rows: Counter((d, t) for d, t, *_ in rows)

    first = plain(rules(spark, docs, sf_dir))
    assert keys(first) == brute_kept(plain(docs)) and len(first) > 60

    second = plain(language(spark, again(first), sf_dir))
    judged = plain_language([r[:3] for r in first], lambda d: d is not None and crc(d) % 5 != 0)
    assert keys(second) == keys([r for r, (lang, score, surprise) in zip(first, judged, strict=True) if lang != "und" and score >= 0.5 and surprise <= langid.MOST_SURPRISE])

    third = plain(dedup(spark, again(second), sf_dir))
    _, group = brute_components(second, corpus_pipeline.SIMILAR)
    by_group = defaultdict(set)
    for r, g in zip(second, group, strict=True):
        by_group[g].add(r[:2])
    assert len(third) == len(by_group) and all(sum(r[:2] in members for r in third) == 1 for members in by_group.values())

    fourth = plain(mixture(spark, again(third), sf_dir))
    sizes, taken = Counter(), Counter()
    for _, t, _, s in third:
        sizes[s] += len(words(t))
    for _, t, _, s in fourth:
        taken[s] += len(words(t))
    largest = max(len(words(t)) for _, t, *_ in third)
    assert set(keys(fourth)) <= set(keys(third)) and max(keys(fourth).values()) <= 2
    assert all(taken[s] <= 2 * sizes[s] for s in sizes) and abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= largest * len(sizes)

    library = Tokenizer.from_file(BPE)
    want = Counter((d, tuple(library.encode(t, add_special_tokens=False).ids)) for d, t, *_ in fourth)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in tokens(spark, again(fourth), sf_dir).collect()) == want
