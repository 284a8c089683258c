"""What is decided about a key's requests in order of time, also where one key has most of the requests: limits, and
answers that are given once.

Requests are dealt out by ranges of key and time, so that a frequent key spans several parts; each part is sorted and
passed through in order, a batch at a time. What a part's first requests get depends on the state in which the part
before left their key. One pass over all parts gives the state each leaves its last key in, begun anew; that is the
state for the next part, but where a part holds nothing but a key that goes on from the part before. Such parts are
handled in between, and only then does a second pass over all parts decide, each from its own entry state:

* A fixed window's part is a function of the entry state: by when the entering window ends, the window that is open at
  the part's end. It has as many steps at most as the part has requests in its first window. Functions of parts that
  follow one another are composed by doubling, in rounds that grow with the logarithm of their number.
* Parts of a sliding log, or of answers, are run from the state that the part before is found to leave, again where that was another
  than thought, until all agree. They soon forget where they began; at worst that takes a round per part.

What reaches the driver is a state per part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom.operators.numbering import with_checkpoints

#: Later than any time, in microseconds.
NEVER = (1 << 63) - 1
State = list[int] | None


class FixedWindow:
    """Begins with a key's first request and ends span later; requests beyond limit are refused but counted. A state
    is the window's begin and the requests in it."""

    fields, more = "allowed boolean, hits int", ()

    def __init__(self, span: int, limit: int):
        self.span, self.limit = span, limit

    def run(self, t: np.ndarray, state: State) -> tuple[np.ndarray, np.ndarray, State]:
        hits, i = np.empty(len(t), np.int64), 0
        if state:
            i = int(np.searchsorted(t, state[0] + self.span))
            hits[:i] = state[1] + 1 + np.arange(i)
            state = [state[0], state[1] + i]
        while i < len(t):
            j = int(np.searchsorted(t, t[i] + self.span))
            hits[i:j] = 1 + np.arange(j - i)
            state, i = [int(t[i]), j - i], j
        return hits <= self.limit, hits, state

    def function(self, t: np.ndarray) -> np.ndarray:
        """Steps (upto, begin, requests): an entering window that ends by upto, and after the step before, leaves the
        window of begin; the last step, of NEVER, has the number of requests that join a window that ends later."""
        n = len(t)
        after = np.searchsorted(t, t + self.span)
        last = np.where(after < n, after, np.arange(n))
        while (last[last] != last).any():
            last = last[last]
        first = np.arange(min(int(after[0]) + 1, n))
        first = first[np.concatenate([[True], t[first[1:]] != t[first[1:] - 1]])]
        steps = np.stack([t[first], t[last[first]], n - last[first]], 1)
        return np.concatenate([_merged(steps), [[NEVER, NEVER, n]]])

    def constant(self, state: State) -> np.ndarray:
        return np.array([[NEVER - 1, *(state or [0, 0])]], np.int64)

    def composed(self, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The function of two parts in a row."""
        steps, joins = own[:-1], int(own[-1, 2])
        known = before[before[:, 0] < NEVER]
        at = np.searchsorted(steps[:, 0], known[:, 1] + self.span)
        begun = at < len(steps)
        through = known + [0, 0, joins]
        if len(steps):
            through = np.where(begun[:, None], np.concatenate([known[:, :1], steps[np.minimum(at, len(steps) - 1), 1:]], 1), through)
        if len(known) == len(before):  # whatever enters
            return through
        later = steps[steps[:, 0] > known[-1, 0]] if len(known) else steps
        return np.concatenate([_merged(np.concatenate([through, later])), [[NEVER, NEVER, joins + int(before[-1, 2])]]])


def _merged(steps: np.ndarray) -> np.ndarray:
    """steps without those that the next one goes on like."""
    return steps[np.concatenate([(steps[1:, 1:] != steps[:-1, 1:]).any(1), [True]])] if len(steps) else steps


class SlidingLog:
    """A request is refused if limit accepted ones lie within the span before it; a state is the log of those."""

    fields, more = "allowed boolean, hits int", ()

    def __init__(self, span: int, limit: int):
        self.span, self.limit = span, limit

    def run(self, t: np.ndarray, state: State) -> tuple[np.ndarray, np.ndarray, State]:
        log, head = list(state or []), 0
        allowed, hits = np.empty(len(t), bool), np.empty(len(t), np.int64)
        for i, at in enumerate(t.tolist()):
            while head < len(log) and log[head] <= at - self.span:
                head += 1
            allowed[i] = ok = len(log) - head < self.limit
            hits[i] = len(log) - head + ok
            if ok:
                log.append(at)
        return allowed, hits, log[head:]


class Answers:
    """A key's first request starts work; until it is completed others are refused, then they are given its answer.
    span after the start, or after the completion if there was one, the key is forgotten. A state is whether the work
    is completed, when it is forgotten and the id of the completion. more: columns that tell completions from requests
    (1 or 0) and their ids."""

    fields = "outcome string, answer long"
    OUTCOMES = ("started", "refused", "answered", "completed")

    def __init__(self, span: int, is_completion: str, id_: str):
        self.span, self.more = span, (is_completion, id_)

    def run(self, t: np.ndarray, state: State, ends: np.ndarray, ids: np.ndarray) -> tuple[list, list, State]:
        outcome, answer = [], []
        for at, end, i in zip(t.tolist(), ends.tolist(), ids.tolist(), strict=True):
            if state and at >= state[1]:
                state = None
            if end:
                state = [1, at + self.span, i]
                outcome.append(3)
            elif not state:
                state = [0, at + self.span, 0]
                outcome.append(0)
            else:
                outcome.append(1 + state[0])
            answer.append(i if end else state[2] if state[0] else None)
        return [self.OUTCOMES[o] for o in outcome], answer, state


Machine = FixedWindow | SlidingLog | Answers


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[Any, int, int]]:
    """Each key of a sorted batch, with where its rows begin and end."""
    keys = batch.column("__key").to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            yield keys[a], a, b


def _read(batch: pa.RecordBatch, machine: Machine) -> list[np.ndarray]:
    """What the machine reads of a batch: the times and its further columns."""
    return [batch.column(c).to_numpy() for c in ("__t", *machine.more)]


def _run(machine: Machine, state: State, read: list[np.ndarray], rows: slice = slice(None)) -> tuple[Any, Any, State]:
    t, *more = (c[rows] for c in read)
    return machine.run(t, state, *more)


def _left(ranges: DataFrame, machine: Machine) -> list[Any]:
    """Of each part that has rows: its number, first and last key, and the state it leaves the last one in if that
    began anew in the part."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = key = state = None
        for batch in batches:
            read = _read(batch, machine)
            for k, a, b in _segments(batch):
                if part is None:
                    part, first = batch.column("__part")[0].as_py(), k
                state = _run(machine, state if k == key else None, read, slice(a, b))[2]
                key = k
        if part is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "first": first, "last": key, "state": state}], pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("state", pa.list_(pa.int64()))]))

    return ranges.select("__key", "__part", "__t", *machine.more).mapInArrow(step, "part int, first string, last string, state array<long>").orderBy("part").collect()


def _blocks(ranges: DataFrame, machine: Machine, parts: list[int]) -> DataFrame:
    """What the machine reads of the given parts: a row per part, an array per column."""
    names = ("__t", *machine.more)
    rows = ranges.select("__part", *names).where(F.col("__part").isin(parts))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            if batch.num_rows:
                part = batch.column("__part")[0].as_py()
                held.append(_read(batch, machine))
        if held:
            arrays = [pa.array([np.concatenate(c)], pa.list_(pa.int64())) for c in zip(*held, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *arrays], ["part", *names])

    return rows.mapInArrow(step, ", ".join(["part int", *[f"`{c}` array<long>" for c in names]])).checkpoint()


def _each(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The parts of blocks."""
    for batch in batches:
        for i, part in enumerate(batch.column("part").to_pylist()):
            yield part, [batch.column(c)[i].values.to_numpy() for c in ("__t", *machine.more)]


FUNCTION = "part int, upto long, begin long, requests long"


def _by_functions(ranges: DataFrame, machine: FixedWindow, entries: dict[int, State], runs: list[list[int]]) -> dict[int, State]:
    """The states that the parts of runs leave, by composed functions; entries holds those that enter a run's first."""

    def rows(part: int, steps: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(steps), part), pa.int32()), *[pa.array(c, pa.int64()) for c in steps.T]]
        return pa.RecordBatch.from_arrays(columns, ["part", "upto", "begin", "requests"])

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (t,) in _each(batches, machine):
            yield rows(part, machine.constant(machine.run(t, entries[part])[2]) if part in entries else machine.function(t))

    table = _blocks(ranges, machine, [p for r in runs for p in r]).mapInArrow(functions, FUNCTION).checkpoint()
    place = {p: (i, r) for r in runs for i, p in enumerate(r)}

    def compose(group: pa.Table) -> pa.Table:
        steps = np.stack([group.column(c).to_numpy() for c in ("upto", "begin", "requests")], 1)
        own = group.column("own").to_numpy(zero_copy_only=False)
        steps, own = steps[order := np.argsort(steps[:, 0], kind="stable")], own[order]
        out = machine.composed(steps[~own], steps[own]) if not own.all() and steps[own][-1, 0] == NEVER else steps[own]
        return pa.Table.from_batches([rows(group.column("part")[0].as_py(), out)])

    far = 1
    while far < max(map(len, runs)):
        onward = {p: r[i + far] for p, (i, r) in place.items() if i + far < len(r)}
        onward_to = F.create_map(*[F.lit(x) for pair in onward.items() for x in pair])[F.col("part")]
        passed = table.where(F.col("part").isin(list(onward))).select(onward_to.alias("part"), "upto", "begin", "requests", F.lit(False).alias("own"))
        table = table.withColumn("own", F.lit(True)).unionByName(passed).groupBy("part").applyInArrow(compose, FUNCTION).checkpoint()
        far *= 2
    return {r["part"]: [r["begin"], r["requests"]] for r in table.collect()}


def _by_trial(ranges: DataFrame, machine: Machine, entries: dict[int, State], runs: list[list[int]]) -> dict[int, State]:
    """The states that the parts of runs leave, found by running them until each has entered as the one before left."""
    blocks = _blocks(ranges, machine, [p for r in runs for p in r])
    tried: dict[int, State] = {}
    left: dict[int, State] = {}
    while True:
        wanted = {p: entries[p] if not i else left.get(r[i - 1]) for r in runs for i, p in enumerate(r)}
        again = {p: s for p, s in wanted.items() if p not in tried or tried[p] != s}
        if not again:
            return left

        def step(batches: Iterator[pa.RecordBatch], again: dict[int, State] = again) -> Iterator[pa.RecordBatch]:
            for part, read in _each(batches, machine):
                state = _run(machine, again[part], read)[2]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([state], pa.list_(pa.int64()))], ["part", "state"])

        found = blocks.where(F.col("part").isin(list(again))).mapInArrow(step, "part int, state array<long>").collect()
        left |= {r["part"]: r["state"] for r in found}
        tried |= again


def entry_states(ranges: DataFrame, machine: Machine) -> dict[int, State]:
    """Of each part whose first key goes on from the part before: the state that key is in."""
    parts = _left(ranges, machine)
    left = {p["part"]: p["state"] for p in parts}
    goes_on = [b["part"] for a, b in zip(parts[:-1], parts[1:], strict=True) if a["last"] == b["first"]]
    before = {b["part"]: a["part"] for a, b in zip(parts[:-1], parts[1:], strict=True)}
    whole = {p["part"] for p in parts if p["first"] == p["last"]} & set(goes_on)
    runs: list[list[int]] = []
    for p in sorted(whole):
        if runs and runs[-1][-1] == before[p]:
            runs[-1].append(p)
        else:
            runs.append([p])
    if runs:
        find = _by_functions if isinstance(machine, FixedWindow) else _by_trial
        left |= find(ranges, machine, {r[0]: left[before[r[0]]] for r in runs}, runs)
    return {p: left[before[p]] for p in goes_on}


def dealt(requests: DataFrame, key: str, ts: str, order: str, parts: int | None = None) -> DataFrame:
    """requests that have a time, in sorted parts by ranges of key, time and order, kept so that they stay in them."""
    with_checkpoints(requests.sparkSession)
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null"))
    timed = requests.withColumns({"__key": name, "__t": F.unix_micros(F.col(ts).cast("timestamp"))}).where("__t is not null")
    by = ("__key", "__t", order)
    ranges = timed.repartitionByRange(parts, *by) if parts else timed.repartitionByRange(*by)
    return ranges.sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id()).checkpoint()


def decided(requests: DataFrame, key: str, ts: str, order: str, machine: Machine, parts: int | None = None) -> DataFrame:
    """requests with the fields of what the machine decides, requests of a time by order. Those without a time are not
    looked at, their fields are null. Repeated rows are requests of their own; null keys are one key."""
    ranges = dealt(requests, key, ts, order, parts)
    entries = entry_states(ranges, machine)
    columns, made = requests.columns, T.StructType.fromDDL(machine.fields)
    kinds = [to_arrow_type(f.dataType) for f in made]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        first = True
        for batch in batches:
            read, found = _read(batch, machine), []
            for k, a, b in _segments(batch):
                if k != key:
                    state = entries.get(batch.column("__part")[0].as_py()) if first else None
                *fields, state = _run(machine, state, read, slice(a, b))
                found.append(fields)
                key, first = k, False
            if found:
                fields = [pa.chunked_array([pa.array(x).cast(kind) for x in each]).combine_chunks() for each, kind in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *fields], [*columns, *made.names])

    timeless = requests.where(F.col(ts).cast("timestamp").isNull()).withColumns({f.name: F.lit(None).cast(f.dataType) for f in made})
    return ranges.mapInArrow(step, T.StructType([*requests.schema.fields, *made.fields])).unionByName(timeless)
