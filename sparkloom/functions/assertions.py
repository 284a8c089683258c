"""Assertions as Boolean columns, for filters and data-quality checks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import unified_diff

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import normalized


def finite(c: Column) -> Column:
    c = c.cast("double")
    return ~F.isnan(c) & (F.abs(c) != float("inf"))


def _numbers(a: Column, b: Column, test: Column) -> Column:
    """test where both are numbers; an error for NaN or infinity."""
    return F.when(finite(a) & finite(b), test).when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("NaN and infinity can't be compared")))


def equal(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    near = F.abs(a - b) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b)), F.lit(float(tolerance)))
    return _numbers(a, b, near)


def not_equal(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    return ~equal(a, b, tolerance)


def greater(a: Column, b: Column) -> Column:
    return _numbers(a, b, a > b)


def less(a: Column, b: Column) -> Column:
    return _numbers(a, b, a < b)


def at_least(a: Column, b: Column) -> Column:
    return _numbers(a, b, a >= b)


def at_most(a: Column, b: Column) -> Column:
    return _numbers(a, b, a <= b)


def in_range(c: Column, low: float, high: float, inclusive: bool = True) -> Column:
    if low > high:
        raise ValueError("the range is empty")
    return c.between(low, high) if inclusive else (c > low) & (c < high)


def fail(message: str) -> Column:
    return F.raise_error(F.lit(message))


def same_text(a: Column, b: Column, **how: bool) -> Column:
    return normalized(a, **how) == normalized(b, **how)


def contains(a: Column, b: Column, **how: bool) -> Column:
    return F.contains(normalized(a, **how), normalized(b, **how))


def not_contains(a: Column, b: Column, **how: bool) -> Column:
    return ~contains(a, b, **how)


def matches(c: Column, pattern: str, flags: str = "") -> Column:
    return c.rlike(f"(?{flags}){pattern}" if flags else pattern)


def same_lines(a: Column, b: Column, **how: bool) -> Column:
    lines = lambda c: F.transform(F.split(F.trim(c), "\n"), lambda x: normalized(x, **how))
    return lines(a) == lines(b)


def levenshtein_share(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer length; an approximation of similarity() that stays in the JVM."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence by the sum of the lengths, by bit-parallel rows."""
    if not a and not b:
        return 1.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & masks.get(c, 0)
        row = ((row + u) | (row - u)) & full
    common = len(a) - row.bit_count()
    return 2 * common / (len(a) + len(b))


def similarity(a: Column, b: Column) -> Column:
    """Ratio of insertions and deletions, 0 to 1; null for a null side."""

    @F.arrow_udf("double")
    def ratio(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array([None if p is None or q is None else indel_ratio(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return ratio(a, b)


def similar(a: Column, b: Column, threshold: float = 0.85, **how: bool) -> Column:
    return similarity(normalized(a, **how), normalized(b, **how)) >= threshold


def nfkc(c: Column) -> Column:
    @F.arrow_udf("string")
    def form(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array([None if p is None else unicodedata.normalize("NFKC", p) for p in x.to_pylist()], pa.string())

    return form(c)


def text_diff(a: Column, b: Column, context: int = 3) -> Column:
    """A unified diff of two texts; empty if they are equal."""

    @F.arrow_udf("string")
    def diff(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array(["\n".join(unified_diff((p or "").splitlines(), (q or "").splitlines(), "expected", "actual", n=context, lineterm="")) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.string())

    return diff(a, b)


def glob_regex(pattern: str) -> str:
    """A file name pattern as an anchored regex: * for any text, ? for a character, [a-z] for one of a set and [!a-z]
    for one of no set. A bracket that isn't closed stands for itself."""
    parts = re.findall(r"\*|\?|\[!?\]?[^\]]*\]|.", pattern, re.S)
    each = lambda p: ".*" if p == "*" else "." if p == "?" else _set(p[1:-1]) if len(p) > 2 and p[0] == "[" else re.escape(p)
    return "(?s)^" + "".join(map(each, parts)) + "$"


def _set(inside: str) -> str:
    negated, inside = inside.startswith("!"), inside.removeprefix("!")
    return f"[{'^' if negated else ''}{re.sub(r'([][^&~|])', lambda m: chr(92) + m[0], inside.replace(chr(92), chr(92) * 2))}]"


def audio_quality(samples: Column, rate: int) -> Column:
    """too_short under 1.5 s, clipped over a peak of 0.98, too_quiet under a root mean square of 0.01, else ok."""
    seconds, peak = F.size(samples) / rate, F.array_max(F.transform(samples, F.abs))
    rms = F.sqrt(F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(samples))
    return F.when(seconds < 1.5, "too_short").when(peak > 0.98, "clipped").when(rms < 0.01, "too_quiet").otherwise("ok")
