"""Limits decided in parts, against a model that sees a key's requests one after the other."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import limits, sync


def fixed(times, seconds, limit):
    out, start, n = [], None, 0
    for t in times:
        if start is None or t >= start + seconds:
            start, n = t, 0
        n += 1
        out.append((n <= limit, n))
    return out


def sliding(times, seconds, limit):
    out, log = [], []
    for t in times:
        log = [x for x in log if x > t - seconds]
        ok = len(log) < limit
        if ok:
            log.append(t)
        out.append((ok, len(log)))
    return out


def requests(spark, keys):
    """keys: times in seconds by key; a request's id is its place in the key's order."""
    rows = [(k, i, int(t * 1e6)) for k, times in keys.items() for i, t in enumerate(sorted(times))]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "k string, id int, t long").select("k", "id", F.timestamp_micros("t").alias("ts"))


def check(spark, keys, seconds, limit, parts, kinds=((sync.fixed_window_limit, fixed), (sync.sliding_log_limit, sliding))):
    df = requests(spark, keys)
    for limiter, model in kinds:
        got = {}
        for r in limiter(df, "k", "ts", "id", seconds, limit, parts).collect():
            got[r["k"], r["id"]] = (r["allowed"], r["hits"])
        want = {(k, i): d for k, times in keys.items() for i, d in enumerate(model([int(t * 1e6) / 1e6 for t in sorted(times)], seconds, limit))}
        assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_a_hot_key_in_many_parts(spark, seed):
    """Half of all requests are of one key, in bursts, pauses and ties."""
    rng = random.Random(seed)
    hot = [rng.choice([rng.uniform(0, 300), rng.randrange(5000, 5100), rng.uniform(0, 20_000)]) for _ in range(400)]
    keys = {"hot": hot} | {f"k{i}": [rng.uniform(0, 500) for _ in range(rng.randrange(1, 20))] for i in range(40)} | {None: [1.0, 2.0, 3.0, 70.0]}
    check(spark, keys, 60, 3, 9)
    ranges = limits.dealt(requests(spark, keys), "k", "ts", "id", 9)
    assert ranges.where("k = 'hot'").select("__part").distinct().count() >= 4


def test_requests_at_even_times_which_never_fall_together(spark):
    """Parts whose windows depend on where the key began, seven of them of one key only."""
    check(spark, {"a": range(5), "b": [7 * i for i in range(300)], "c": range(3)}, 60, 4, 8)


def test_parts_shorter_and_longer_than_a_window(spark):
    rng = random.Random(1)
    check(spark, {"k": [rng.uniform(0, 100) for _ in range(300)]}, 45, 50, 10)
    check(spark, {"k": [rng.uniform(0, 100) for _ in range(120)]}, 1000, 5, 10)
    check(spark, {"k": [i * 100.0 for i in range(60)]}, 45, 1, 7)
    check(spark, {"k": [5.0] * 50 + [6.0] * 50}, 45, 60, 7)


def test_functions_of_parts_are_composed():
    rng = random.Random(3)
    for _ in range(300):
        span = rng.choice([5, 30, 200])
        machine = limits.FixedWindow(span, 2)
        t = np.sort(np.array([rng.randrange(rng.choice([60, 600])) for _ in range(rng.randrange(3, 40))]))
        cuts = sorted({0, len(t), *(rng.randrange(1, len(t)) for _ in range(rng.randrange(1, 4)))})
        whole = None
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            whole = machine.function(t[a:b]) if whole is None else machine.composed(whole, machine.function(t[a:b]))
        for begin in range(int(t[0]) - 2 * span, int(t[0]) + 1, max(1, span // 7)):
            step = whole[np.searchsorted(whole[:, 0], begin + span)]
            state = [begin, 7 + int(step[2])] if step[0] == limits.NEVER else [int(step[1]), int(step[2])]
            assert state == machine.run(t, [begin, 7])[2]
        known = machine.constant(machine.run(t[: cuts[1]], None)[2])
        for a, b in zip(cuts[1:-1], cuts[2:], strict=True):
            known = machine.composed(known, machine.function(t[a:b]))
        assert known.tolist() == [[limits.NEVER - 1, *machine.run(t, None)[2]]]


def test_no_requests(spark):
    df = requests(spark, {"a": [1.0]}).limit(0)
    assert sync.fixed_window_limit(df, "k", "ts", "id").collect() == [] and sync.idempotent(df, "k", "ts", "id").columns == ["k", "id", "ts", "fresh"]


def answers(events, span):
    """(outcome, answer) of (time, completes, response) in order."""
    out, state = [], None
    for t, ends, response in events:
        if state and t >= state[1]:
            state = None
        if ends:
            state = (response, t + span, True)
            out.append(("completed", response))
        elif not state:
            state = (None, t + span, False)
            out.append(("started", None))
        else:
            out.append(("answered", state[0]) if state[2] else ("refused", None))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_answers_of_a_hot_key_in_many_parts(spark, seed):
    rng = random.Random(seed)
    keys = {"hot": sorted(rng.randrange(0, 400) for _ in range(300))} | {f"k{i}": sorted(rng.randrange(0, 400) for _ in range(rng.randrange(1, 9))) for i in range(30)}
    rows, want = [], {}
    for k, times in keys.items():
        events = [(t, rng.random() < 0.05, rng.choice([None, "r", f"r{i}"])) for i, t in enumerate(times)]
        for t, ends, response in events:
            rows.append((k, len(rows), t * 3600 * 10**6, ends or rng.choice([False, None]), response))
        want |= dict(zip(range(len(rows) - len(events), len(rows)), answers(events, 24), strict=True))
    rows += [(None, len(rows), 0, False, None), (None, len(rows) + 1, 1, True, "x"), ("hot", len(rows) + 2, None, False, None)]
    want |= {len(rows) - 3: ("started", None), len(rows) - 2: ("completed", None), len(rows) - 1: (None, None)}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, id long, t long, done boolean, response string").withColumn("ts", F.timestamp_micros("t"))
    found = sync.answered(df, "k", "ts", "id", "response", F.col("done"), parts=8)
    assert found.columns == [*df.columns, "outcome", "answer"]
    assert {r["id"]: (r["outcome"], r["answer"]) for r in found.collect()} == want
