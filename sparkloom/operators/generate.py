"""Synthetic data: distributions, typed columns and profiles, as expressions over the key of a table's rows.

Each value follows from its row's key, a seed and a number by a hash, so that a table is the same however it is
partitioned and if a task runs again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.reshape import datatype_spec

#: Fixed value: the characters of random texts.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ1234567890@#$%^&*()_+-`~=;:',<.>?*"
ID = "id"
#: Steps of a discrete distribution up to which it is drawn by an expression.
STEPS = 200


def unit(seed: int, number: int | Column = 0, key: str | Column = ID) -> Column:
    """An even draw from between 0 and 1, of 52 bits."""
    key = F.col(key) if isinstance(key, str) else key
    number = number if isinstance(number, Column) else F.lit(number)
    digits = F.substring(F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed)), number.cast("string")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))


def below(n: int, seed: int, number: int | Column = 0, key: str | Column = ID) -> Column:
    """A whole number from 0 to n - 1."""
    return F.floor(unit(seed, number, key) * n).cast("int")


def _normal(seed: int, key: str | Column) -> Column:
    return F.sqrt(-2 * F.ln(unit(seed, 0, key))) * F.cos(2 * math.pi * unit(seed, 1, key))


def _gamma(shape: int, seed: int, key: str | Column, first: int = 0) -> Column:
    """For whole shapes: the sum of so many exponential draws."""
    total = F.lit(0.0)
    for i in range(first, first + shape):
        total = total - F.ln(unit(seed, i, key))
    return total


def cumulated(weights: Sequence[float]) -> list[float]:
    """The probabilities of 0, of at most 1, ... but for the last, which is 1."""
    out, total = [], 0.0
    for w in weights:
        total += w
        out.append(total)
    return out[:-1]


def poisson_steps(lam: float) -> list[float]:
    """Up to where what is left is less than a draw can tell."""
    last = int(lam + 12 * math.sqrt(lam) + 20)
    return cumulated([math.exp(-lam + k * math.log(lam) - math.lgamma(k + 1)) for k in range(last + 1)])


def binomial_steps(n: int, p: float) -> list[float]:
    return cumulated([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])


def _stepped(steps: list[float], seed: int, key: str | Column) -> Column:
    """The number of steps that a draw is above."""
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.struct(unit(seed, 0, key).alias("u"), F.lit(0).alias("n")), lambda a, s: F.struct(a["u"].alias("u"), (a["n"] + (a["u"] > s).cast("int")).alias("n")), lambda a: a["n"].cast("double"))


def _numpy(draw: Callable[[np.random.Generator], float], seed: int, key: str | Column) -> Column:
    """Drawn in numpy, where there is no expression; a row's generator is seeded by its own draw."""

    @F.arrow_udf("double")
    def drawn(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for units in batches:
            yield pa.array([float(draw(np.random.default_rng(int(u * (1 << 52))))) for u in units.to_numpy()], pa.float64())

    return drawn(unit(seed, 0, key))


def _poisson(seed: int, key: str | Column, lam: float = 5.0) -> Column:
    return _stepped(poisson_steps(lam), seed, key) if 0 < lam and lam + 12 * math.sqrt(lam) + 20 < STEPS else _numpy(lambda g: g.poisson(lam), seed, key)


def _binomial(seed: int, key: str | Column, n: int = 10, p: float = 0.5) -> Column:
    return _stepped(binomial_steps(n, p), seed, key) if 0 < n < STEPS else _numpy(lambda g: g.binomial(n, p), seed, key)


def _any_gamma(seed: int, key: str | Column, shape: float = 2.0, scale: float = 2.0) -> Column:
    return _gamma(int(shape), seed, key) * scale if shape == int(shape) and shape < STEPS else _numpy(lambda g: g.gamma(shape, scale), seed, key)


def _beta(seed: int, key: str | Column, a: float = 2.0, b: float = 5.0) -> Column:
    if a != int(a) or b != int(b) or a + b >= STEPS:
        return _numpy(lambda g: g.beta(a, b), seed, key)
    x = _gamma(int(a), seed, key)
    return x / (x + _gamma(int(b), seed, key, int(a)))


DISTRIBUTIONS: dict[str, Callable[..., Column]] = {
    "uniform": lambda seed, key, low=0.0, high=100.0: unit(seed, 0, key) * (high - low) + low,
    "normal": lambda seed, key, loc=0.0, scale=1.0: _normal(seed, key) * scale + loc,
    "exponential": lambda seed, key, scale=1.0: -scale * F.ln(unit(seed, 0, key)),
    "poisson": _poisson,
    "binomial": _binomial,
    "gamma": _any_gamma,
    "beta": _beta,
    "pareto": lambda seed, key, a=2.0: F.pow(unit(seed, 0, key), F.lit(-1 / a)) - 1,
    "weibull": lambda seed, key, a=1.0: F.pow(-F.ln(unit(seed, 0, key)), F.lit(1 / a)),
    "lognormal": lambda seed, key, mean=0.0, sigma=1.0: F.exp(mean + sigma * _normal(seed, key)),
}


def distribution(name: str, seed: int, key: str | Column = ID, **params: Any) -> Column:
    """A column of the named distribution; an unknown name is uniform."""
    return DISTRIBUTIONS.get(name, DISTRIBUTIONS["uniform"])(seed, key, **params)


def random_text(n: int, seed: int, alphabet: str = ALPHABET, key: str | Column = ID) -> Column:
    one = lambda i: F.substring(F.lit(alphabet), below(len(alphabet), seed, i, key) + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), one), "")


def typed(kind: str, seed: int, dist: str = "uniform", start: str = "2020-01-01", key: str | Column = ID, **params: Any) -> Column:
    """A column of type int2, int4, int8 (8 bits), float4, float8, char, varchar(n), uuid, date, datetime or time;
    anything else is int4. Whole numbers are clipped to their type, then cut off."""
    base, _, size = kind.partition("(")
    x = distribution(dist, seed, key, **params)
    clipped = lambda lo, hi, t: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)).cast(t)
    days = F.greatest(F.lit(0), x.cast("int"))
    of_key = (F.col(key) if isinstance(key, str) else key).cast("string")
    kinds: dict[str, Callable[[], Column]] = {
        "int2": lambda: clipped(-32768, 32767, "short"),
        "int4": lambda: clipped(-2147483648, 2147483647, "int"),
        "int8": lambda: clipped(-128, 127, "byte"),
        "float4": lambda: x.cast("float"),
        "float8": lambda: x.cast("double"),
        "char": lambda: random_text(1, seed, key=key),
        "varchar": lambda: random_text(int(size.rstrip(")") or 10), seed, key=key),
        "uuid": lambda: F.regexp_replace(F.md5(F.concat_ws("-", of_key, F.lit(str(seed)))), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        "date": lambda: F.date_add(F.lit(start).cast("date"), days),
        "datetime": lambda: F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + F.greatest(F.lit(0.0), x).cast("long")),
        "time": lambda: F.date_format(F.timestamp_seconds(F.pmod(F.abs(x * 3600).cast("long"), F.lit(86400))), "HH:mm:ss"),
    }
    return kinds.get(base, kinds["int4"])()


def named_types(columns: int, spec: str = "") -> list[tuple[str, str]]:
    """Name and type of columns: those that spec names, as type_i, filled up with int4."""
    wanted = datatype_spec(spec) if spec else {}
    if sum(wanted.values()) > columns:
        raise ValueError("the specification has more columns than the table")
    if rest := columns - sum(wanted.values()):
        wanted["int4"] = wanted.get("int4", 0) + rest
    return [(f"{k}_{i}", k) for k, n in wanted.items() for i in range(1, n + 1)]


def with_columns(df: DataFrame, key: str, columns: int, spec: str = "", dist: str = "uniform", seed: int = 0) -> DataFrame:
    """df with columns drawn for each row by its key."""
    return df.select("*", *[typed(kind, seed + j, dist, key=key).alias(name) for j, (name, kind) in enumerate(named_types(columns, spec))])


def table(spark: SparkSession, columns: int, rows: int, spec: str = "", dist: str = "uniform", seed: int = 0, chunk: int = 10_000) -> DataFrame:
    """rows of the types that spec names, a partition per chunk."""
    return with_columns(spark.range(0, rows, 1, max(1, -(-rows // chunk))), ID, columns, spec, dist, seed).drop(ID)


def pattern_text(pattern: str, seed: int, key: str | Column = ID) -> Column:
    """pattern with each ? as a letter and each # as a digit."""
    parts = [F.chr(65 + below(26, seed, i, key)) if c == "?" else below(10, seed, i, key).cast("string") if c == "#" else F.lit(c) for i, c in enumerate(pattern)]
    return F.concat(*parts)


def pick(values: list[str], seed: int, key: str | Column = ID) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), below(len(values), seed, 0, key) + 1)


def date_between(start: str, end: str, seed: int, key: str | Column = ID) -> Column:
    days = F.date_diff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    return F.date_add(F.lit(start).cast("date"), F.floor(unit(seed, 0, key) * days).cast("int"))


def _measure(low: float, high: float, seed: int, key: str | Column) -> Column:
    return F.round(unit(seed, 0, key) * (high - low) + low, 2)


PROFILES: dict[str, Callable[[int, str | Column], Mapping[str, Column]]] = {
    "personal": lambda s, k: {"first_name": pick(["Ada", "Ben", "Chloe", "Dan", "Eve", "Finn"], s, k), "last_name": pick(["Hill", "Lake", "Moor", "Reed", "Wood"], s + 1, k), "birth_date": date_between("1940-01-01", "2005-12-31", s + 2, k), "height_cm": _measure(140, 200, s + 3, k), "weight_kg": _measure(45, 115, s + 4, k), "phone": pattern_text("###-###-####", s + 5, k)},
    "medical": lambda s, k: {"payer_code": pattern_text("??-####", s, k), "provider_code": pattern_text("PR######", s + 1, k), "admitted": date_between("2020-01-01", "2024-12-31", s + 2, k), "blood_group": pick(["A+", "A-", "B+", "B-", "AB+", "AB-", "0+", "0-"], s + 3, k)},
    "insurance": lambda s, k: {"policy": pattern_text("??#######", s, k), "plan": pick(["basic", "plus", "full"], s + 1, k), "premium": _measure(100, 1000, s + 2, k), "starts": date_between("2020-01-01", "2024-12-31", s + 3, k)},
    "generic": lambda s, k: {"code": pattern_text("??-###", s, k), "note": random_text(20, s + 1, key=k), "created": date_between("2020-01-01", "2024-12-31", s + 2, k)},
}


def with_profile(df: DataFrame, key: str, kind: str, seed: int = 0) -> DataFrame:
    """df with the columns of a profile, personal, medical, insurance or generic, drawn for each row by its key."""
    return df.select("*", *[c.alias(n) for n, c in PROFILES[kind](seed, key).items()])


def profiles(spark: SparkSession, kind: str, rows: int, seed: int = 0) -> DataFrame:
    """rows of a profile."""
    return with_profile(spark.range(rows), ID, kind, seed)
