"""Words of a batch of texts as numbers, cut and hashed in Arrow and numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SPACE = " \t\n\x0b\f\r"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts, A-Z lower-cased: each word's number, all texts in a row; how many words each text has (null: none);
    and the 64-bit hash of each number's word."""
    trimmed = pc.ascii_trim(pc.ascii_lower(pc.fill_null(texts, "")), SPACE)
    lists = pc.split_pattern_regex(trimmed, f"[{SPACE}]+")
    sizes = np.where(pc.equal(trimmed, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy())
    words = pc.list_flatten(lists).dictionary_encode()
    number = words.indices.to_numpy().astype(np.int64)
    if (empty := pc.index_in(pa.scalar(""), words.dictionary).as_py()) is not None:
        number = number[number != empty]
    return number, sizes.astype(np.int64), pd.util.hash_array(words.dictionary.to_numpy(zero_copy_only=False), categorize=False)


def slices(texts: pa.Array, size: int) -> Iterator[slice]:
    """Ranges of texts of at most size bytes in all, or of one text that is longer."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
        yield slice(start, stop)
        start = stop


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two 64-bit hashes in order."""
    x = (a * np.uint64(0xBF58476D1CE4E5B9)) ^ (b + np.uint64(0x9E3779B97F4A7C15) + (a << np.uint64(6)) + (a >> np.uint64(2)))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))
