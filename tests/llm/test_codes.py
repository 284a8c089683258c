"""Vector codes on odd rows, against plain loops."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from sparkloom.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label string, code string, error double, data string, __label int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1.5, "d", 3) for r in rows], SCHEMA).repartition(3)


def plain(rows):
    fine = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    dims = 16 * max(1, math.ceil(max((len(r[1]) for r in fine), default=0) / 16))
    width = dims // 16
    clip = lambda x: max(-codes.LARGEST, min(codes.LARGEST, math.floor(x * 256)))
    ints = lambda v: [clip(x) for x in [*v, *[0.0] * (dims - len(v))]]
    kept = [(i, ints(v), label) for i, v, label in fine]
    first = sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]
    books = [[ints(v)[p * width : (p + 1) * width] for _, v, _ in first] for p in range(16)]

    def assign(v):
        out = []
        for p in range(16):
            part = v[p * width : (p + 1) * width]
            out.append(min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(books[p])))
        return out

    for _ in range(2):
        members = defaultdict(list)
        for _, v, _ in kept:
            for p, (_, j) in enumerate(assign(v)):
                members[p, j].append(v[p * width : (p + 1) * width])
        for (p, j), m in members.items():
            books[p][j] = [sum(c) // len(m) for c in zip(*m, strict=True)]
    found = [(i, label, assign(v)) for i, v, label in kept]
    errors = defaultdict(int)
    for _, label, f in found:
        errors[label] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), errors[label], digest) for i, label, f in found)


def check(spark, rows):
    got = Counter(tuple(r) for r in codes.compressed(frame(spark, rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == plain(rows)


def test_codes_of_odd_rows_are_those_of_plain_loops(spark):
    rng = random.Random(5)
    vector = lambda n: [rng.gauss(0, 0.3) for _ in range(n)]
    rows = [(i, vector(32), ["a", "b", None][i % 3]) for i in range(90)]
    rows += [(200, None, "a"), (201, [*vector(31), math.nan], "a"), (202, [*vector(31), math.inf], None), (203, [*vector(31), None], "a"), (204, [*vector(31), -math.inf], "b")]
    rows += [(-5, vector(10), "short"), (-4, [], "none"), (None, vector(32), "a"), (None, None, None), (3, vector(32), "twice"), rows[7], rows[7], (300, [1e300, -1e300, *vector(30)], "huge"), (301, [-0.0] * 32, "")]
    check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(1, None, "a")], [(1, [], "a"), (2, [], None)], [(1, [0.5] * 16, None)] * 3, [(i % 2, [float(i)] * 17, "a") for i in range(5)]])
def test_codes_of_few_rows(spark, rows):
    check(spark, rows)


def test_codes_do_not_depend_on_partitions_and_decode(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(i % 70, 0.01) for _ in range(64)], "a") for i in range(400)]
    table = frame(spark, rows)
    one, many = (codes.compress(table.repartition(n)) for n in (1, 17))
    assert (one[1] == many[1]).all()
    want = {r["vec_id"]: (r["code"], r["error"]) for r in one[0].collect()}
    assert {r["vec_id"]: (r["code"], r["error"]) for r in many[0].collect()} == want
    vectors = {i: v for i, v, _ in rows}
    for r in codes.decode(*one).collect():
        ints = [math.floor(256 * x) for x in vectors[r["vec_id"]]]
        assert sum((a - 256 * b) ** 2 for a, b in zip(ints, r["approximation"], strict=True)) == r["error"]
