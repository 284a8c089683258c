"""Byte-level BPE encoding and decoding by speculation and verification.

Each word that the pre-tokenizer cuts out is first split greedily into the longest tokens. Such a split is the
right one exactly if every adjacent pair of its tokens is stable: merging the bytes of the two tokens together
gives the two tokens back. Stability is checked for all pairs of a batch at once, in numpy, by walking down the
pairs' facing edges. Only words with an unstable pair are merged step by step.

Null and empty texts have no tokens. Texts are encoded whole, whatever their length; equal rows give equal rows.
Extra columns pass through.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import small_batches

#: The pre-tokenizer's pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose tokens a worker remembers; all are forgotten beyond it.
REMEMBERED = 150_000
#: Bytes of the words that are merged side by side; longer ones are merged one at a time.
SHORT = 100
#: Code points of the texts encoded together.
BLOCK = 2_000_000


def byte_characters() -> dict[str, int]:
    """Character by which vocabulary files write each byte -> byte: printable Latin-1 characters stand for
    themselves, the other bytes in order for the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A vocabulary read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte, vocab = byte_characters(), spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.size, self.rank = size, {(int(a), int(b)): (r, int(c)) for r, (a, b, c) in enumerate(zip(left, right, made, strict=True))}
        order = np.argsort(left * size + right, kind="stable")
        self.pair_keys, self.pair_ranks = (left * size + right)[order], order.astype(np.int64)
        #: Of each token: the rank of the merge that makes it and its two halves; never: len(merges).
        self.never, self.made = len(merges), made
        self.made_at = np.full(size, -1, np.int64)
        self.first_half, self.second_half = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for a, b, c, r in zip(left[::-1], right[::-1], made[::-1], range(len(merges) - 1, -1, -1), strict=True):
            self.first_half[c], self.second_half[c], self.made_at[c] = a, b, r
        #: Tokens that merging their own bytes gives back; only these are proposed.
        meets = self._first_crossing(left, right)
        sound = {i for i in vocab.values() if len(self.bytes[i]) == 1}
        for a, b, c, r in zip(left.tolist(), right.tolist(), made.tolist(), meets.tolist(), strict=True):
            if a in sound and b in sound and r == self.made_at[c]:
                sound.add(c)
        self.tokens = {self.bytes[i]: i for i in sound}
        self._grow_trie()
        self.single = [self.tokens.get(bytes([b]), -1) for b in range(256)]
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.known: dict[str, tuple[int, ...]] = {}

    def _first_crossing(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the first merge that crosses the border when the bytes of left[i] and right[i] are merged
        together, or never. Facing edges a of left and b of right change at the merges that swallow them; a cross
        merge of (a, b) happens if it ranks before both. At equal ranks the leftmost pair goes first, so a cross
        merge must rank strictly before the one that swallows a, and may tie with the one that swallows b."""
        out = np.full(len(left), self.never, np.int64)
        at, a, b = np.arange(len(left)), left.copy(), right.copy()
        end = np.full(len(left), self.never, np.int64)  # a cross merge must rank below
        while len(at):
            rank = self.ranks(a, b)
            crossed = rank < end
            out[at[crossed]] = rank[crossed]
            # go back before the later of the two merges that made a and b
            back_a, back_b = self.made_at[a], self.made_at[b]
            go = ~crossed & (np.maximum(back_a, back_b) >= 0)
            at, a, b, back_a, back_b = at[go], a[go], b[go], back_a[go], back_b[go]
            on_left = back_a > back_b
            end = np.where(on_left, back_a, back_b + 1)
            a, b = np.where(on_left, self.second_half[a], a), np.where(on_left, b, self.first_half[b])
        return out

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the merges of pairs (a, b); never where there is none."""
        keys = a * self.size + b
        found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[found] == keys, self.pair_ranks[found], self.never)

    def stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self._first_crossing(left, right) == self.never

    def _grow_trie(self) -> None:
        """Nodes are the tokens' prefixes; edges as sorted keys node * 256 + byte."""
        nodes: dict[bytes, int] = {b"": 0}
        keys, ends = [], []
        for token in sorted(self.tokens):
            for j in range(1, len(token) + 1):
                if token[:j] not in nodes:
                    nodes[token[:j]] = len(nodes)
                    keys.append(nodes[token[: j - 1]] * 256 + token[j - 1])
                    ends.append(nodes[token[:j]])
        order = np.argsort(keys)
        self.edges, self.targets = np.array(keys)[order], np.array(ends)[order]
        self.node_token = np.full(len(nodes), -1, np.int64)
        for prefix, node in nodes.items():
            self.node_token[node] = self.tokens.get(prefix, -1)

    def greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest tokens from the left: all words' ids in a row, and the word that each belongs to. Every word
        walks the trie a byte a turn; where it can't go on, it takes the longest token passed and starts anew."""
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(size)
        word, at, stop = np.arange(len(words)), stop - size, stop
        start, node = at.copy(), np.zeros(len(words), np.int64)
        token, past = node - 1, at.copy()  # the longest token passed since start, and where it ends
        out_word, out_start, out_token = [], [], []
        while len(word):
            keys = node * 256 + data[at]
            found = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
            ok = (self.edges[found] == keys) & (at < stop)
            node, at = np.where(ok, self.targets[found], 0), at + 1
            here = np.where(ok, self.node_token[node], -1)
            token, past = np.where(here >= 0, here, token), np.where(here >= 0, at, past)
            if not ok.all():
                no = ~ok
                out_word.append(word[no]), out_start.append(start[no]), out_token.append(token[no])
                at, start = np.where(no, past, at), np.where(no, past, start)
                if (on := ok | (past < stop)).all():
                    continue
                word, at, stop, start, node, token, past = word[on], at[on], stop[on], start[on], node[on], token[on], past[on]
        order = np.argsort(np.concatenate([np.empty(0, np.int64), *out_start]))
        pick = lambda x: np.concatenate([np.empty(0, np.int64), *x])[order]
        return pick(out_token), pick(out_word)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many short words at once: each turn every word merges its pair of the lowest rank,
        the leftmost of equals."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), size)
        ids = np.array(self.single, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full(len(ids), self.never, np.int64)  # of the pair that begins here
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.ranks(ids[inner], ids[inner + 1])
        done: list[list[int]] = [[] for _ in words]
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(ids)))
            ended = lowest == self.never
            for f, n in zip(first[ended].tolist(), count[ended].tolist(), strict=True):
                done[owner[f]] = ids[f : f + n].tolist()
            hit = np.flatnonzero((rank == np.repeat(lowest, count)) & np.repeat(~ended, count))
            at = hit[np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])] if len(hit) else hit
            ids[at] = self.made[rank[at]]
            keep = np.repeat(~ended, count)
            keep[at + 1] = False
            where = np.cumsum(keep) - 1
            ids, owner, rank, at = ids[keep], owner[keep], rank[keep], where[at]
            for k in (at - 1, at):
                k = k[(k >= 0) & (k < len(ids))]
                two = (k + 1 < len(ids)) & (owner[k] == owner[np.minimum(k + 1, len(ids) - 1)])
                rank[k] = self.never
                rank[k[two]] = self.ranks(ids[k[two]], ids[k[two] + 1])
        return done

    def exact(self, word: bytes) -> list[int]:
        """Merges the lowest rank, leftmost first, with a heap over a linked list."""
        ids = [self.single[b] for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r[0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if (r := self.rank.get(p))]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else len(ids)
            if j >= len(ids) or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = self.rank[pair][1], -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(ids) and (r := self.rank.get(p := (ids[k], ids[after[k]]))):
                    heapq.heappush(heap, (r[0], k, p))
        return [i for i in ids if i >= 0]

    def learn(self, words: set[str]) -> None:
        """Adds the tokens of words to those known."""
        names = sorted(words, key=len)
        raw = [w.encode() for w in names]
        flat, owner = self.greedy(raw)
        inside = owner[1:] == owner[:-1]
        keys, which = np.unique((flat[:-1] * self.size + flat[1:])[inside], return_inverse=True)
        bad = np.unique(owner[1:][inside][~self.stable(keys // self.size, keys % self.size)[which]])
        ids, ends = flat.tolist(), np.searchsorted(owner, np.arange(len(raw) + 1)).tolist()
        self.known.update((w, tuple(ids[a:b])) for w, a, b in zip(names, ends, ends[1:], strict=False))
        short = [i for i in bad.tolist() if len(raw[i]) <= SHORT]
        self.known.update((names[i], tuple(t)) for i, t in zip(short, self.merge([raw[i] for i in short]), strict=True))
        self.known.update((names[i], tuple(self.exact(raw[i]))) for i in bad.tolist() if len(raw[i]) > SHORT)

    def pieces(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return self.words.findall(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self.words.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.words.findall(text[at:])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin and end."""
        words = [self.pieces(t) for t in texts]
        if new := set(chain.from_iterable(words)).difference(self.known):
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = set(chain.from_iterable(words))
            self.learn(new - self.added.keys())
            self.known.update((t, (i,)) for t, i in self.added.items())
        ids, ends = [], [0]
        for w in words:
            ids.append(np.fromiter(chain.from_iterable(map(self.known.__getitem__, w)), np.int32))
            ends.append(ends[-1] + len(ids[-1]))
        return np.concatenate([np.empty(0, np.int32), *ids]), np.array(ends, np.int64)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def blocks(lengths: list[int], most: int = BLOCK) -> Iterator[slice]:
    """Runs of rows with about most code points each; one row at least."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def _encoded(batch: pa.Array, bpe: ByteBpe) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for rows in blocks(pc.fill_null(pc.utf8_length(batch), 0).to_pylist()):
        yield bpe.encode([t or "" for t in batch[rows].to_pylist()])


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with the token ids of text, array<int>. path: a tokenizers file that every executor can read."""

    small_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = vocabulary(path)
        for batch in batches:
            for flat, ends in _encoded(batch, bpe):
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        bpe.known.clear()  # the worker may be kept for other work

    return docs.withColumn(into, ids(F.col(text)))


def decode(tokens: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """tokens with the text of ids. Null ids give a null text; bytes that aren't UTF-8 give U+FFFD."""

    small_batches(tokens.sparkSession)

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = vocabulary(path)
        for batch in batches:
            ends, flat, valid = batch.offsets.to_pylist(), batch.values.to_numpy(zero_copy_only=False), batch.is_valid().to_pylist()
            yield pa.array([bpe.decode(flat[a:b].tolist()) if ok else None for a, b, ok in zip(ends, ends[1:], valid, strict=False)], pa.string())

    return tokens.withColumn(into, texts(F.col(ids)))


def round_trip(docs: DataFrame, path: str, text: str = "text", into: str = "tokens", keep_ids: bool = False) -> DataFrame:
    """docs with a struct of what encode() and then decode() give for text, in one pass: n_tokens, ids_sha256 of the
    decimal ids joined by commas, decoded_sha256 of the decoded text, and on demand the ids."""
    small_batches(docs.sparkSession)
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string" + ", ids: array<int>" * keep_ids + ">")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = vocabulary(path)
        decimal = [str(i) for i in range(bpe.size)]
        for batch in batches:
            for flat, ends in _encoded(batch, bpe):
                ids_sha, text_sha = [], []
                for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
                    ids = flat[a:b].tolist()
                    ids_sha.append(sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(sha256(bpe.decode(ids).encode()).hexdigest())
                columns = [pa.array(np.diff(ends), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
                yield pa.StructArray.from_arrays(columns, names)
        bpe.known.clear()  # the worker may be kept for other work

    return docs.withColumn(into, digests(F.col(text)))
