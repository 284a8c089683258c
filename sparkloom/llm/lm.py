"""Bigram language model by deleted interpolation.

A token's probability mixes three estimates: the share of its bigram among those of the token before it, its own
share among all tokens, and an even share for each known token and one unknown. The weights of the mix depend on how
often the token before it was seen, in buckets by powers of two, and are learned by expectation-maximisation on
held-out counts: those of every document of one training fold, scored by the counts of all training documents less
its own.

Documents are packed into blocks. A block asks for the counts of its distinct tokens and bigrams once, by hash, in
one request per shard of the key space; the shard adds up what all blocks have counted and answers each of them. So
the corpus' counts are never in one place, and what is shuffled grows with the distinct keys of blocks: a request
takes some five bytes a key, and there are never more requests than shards for a block, nor than its keys. Frequent
keys, which would cost their shard an entry per block, aren't asked for: every task adds up its own counts of them and
gives them once, and their sums are broadcast. Which keys are frequent is read off a few blocks; that decides by which
of the two ways a key is counted, never its count. Answers are written; scoring reads block and answers together.

Tokens are known by 64-bit hashes: among v different tokens some two are taken for one with probability v * v / 2**65.
Bigrams, whose counts only enter the model, are known by so many bits, 48 at least, that fewer than one in 100,000 is
taken for another. Null and empty texts are their end token alone. Documents with a null id are not learned from, and
are not held out. Equal rows count each time and score alike. A document is scored whole; the only thing that is held
at once is a block, or one document if that is longer. An empty table gives no rows; without training tokens the model
is even.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, small
from sparkloom.llm.tokens import mixed, words_of

FOLDS, HELD_OUT, TUNING = 7, 2, 3
#: Bytes of text in a block, and of text for each shard of the key space.
BLOCK = 6 << 20
BUCKETS = 16
#: Steps by which held-out estimates are told apart, per power of two; with BUCKETS it bounds what the driver gets.
STEPS = 4
ROUNDS = 40
END = np.uint64(0x9E3779B97F4A7C15)
#: Blocks that tell which keys are frequent, those that occur FREQUENT times in at least half of these; how many at most;
#: and how many a row holds.
LOOKED_AT, FREQUENT, COMMON, SLICE = 16, 3, 200_000, 256


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs, first bytes first, compressed if they are many;
    before them, that number of bytes, and whether and to what length to decompress."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    data = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    if len(data) < 100:
        return bytes([width]) + data
    return bytes([width | 16]) + len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    width = data[0] & 15
    raw = pa.decompress(data[9:], int.from_bytes(data[1:9], "little"), "zstd", asbytes=True) if data[0] & 16 else data[1:]
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents (doc_id, held_out, learn, tuning, text); those of the tuning fold have their own."""
    part, made = TaskContext.get().partitionId(), 0

    def block(rows: list[pa.RecordBatch], tuning: bool) -> pa.RecordBatch:
        nonlocal made
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for r in rows:
                out.write_batch(r)
        made += 1
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made]), pa.array([tuning]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "tuning", "docs"])

    held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
    size = {False: 0, True: 0}
    for batch in batches:
        tuning_fold = batch.column("tuning")
        for tuning in (False, True):
            rows = batch.filter(tuning_fold if tuning else pc.invert(tuning_fold)).drop_columns(["tuning"])
            ends = np.cumsum(pc.fill_null(pc.binary_length(rows.column("text")), 0).to_numpy())
            start = 0
            while start < len(ends):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK - size[tuning], "right")))
                held[tuning].append(rows.slice(start, stop - start))
                size[tuning] += int(ends[stop - 1] - before)
                start = stop
                if size[tuning] >= BLOCK or start < len(ends):
                    yield block(held[tuning], tuning)
                    held[tuning], size[tuning] = [], 0
    for tuning, rows in held.items():
        if rows:
            yield block(rows, tuning)


class Block(NamedTuple):
    """Tokens of a block's documents; words by their place in keys, pairs by theirs in pair_keys, both sorted."""

    docs: pa.Table
    doc: np.ndarray  # of each token
    word: np.ndarray
    before: np.ndarray  # the word before it
    pair: np.ndarray
    keys: np.ndarray
    pair_keys: np.ndarray


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts in a row, with number 0 at the end of each text; the text of each; and the hash of
    each number."""
    number, sizes, hashes = words_of(texts)
    ends = np.cumsum(sizes + 1) - 1
    out = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.int64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = number + 1
    return out, np.repeat(np.arange(len(sizes)), sizes + 1), np.concatenate([[END], hashes]).astype(np.uint64)


def opened(data: bytes, width: int) -> Block:
    """A block, its pairs known by width bits."""
    docs = pa.ipc.open_stream(data).read_all().combine_chunks()
    texts = docs.column("text")
    word, doc, hashes = tokens_of(texts.chunk(0) if texts.num_chunks else pa.array([], pa.string()))
    keys, place = np.unique(hashes, return_inverse=True)
    word = place[word]
    before = np.concatenate([place[:1], word[:-1]]) if len(word) else word  # the end of a text comes before the next
    both, pair = np.unique(before * len(keys) + word, return_inverse=True)
    pair_keys, order = np.unique(mixed(keys[both // len(keys)], keys[both % len(keys)]) >> np.uint64(64 - width), return_inverse=True)
    return Block(docs, doc, word, before, order[pair], keys, pair_keys)


class Common(NamedTuple):
    """Frequent words and pairs, sorted, and their counts once these are known."""

    keys: tuple[np.ndarray, np.ndarray]
    counts: tuple[np.ndarray, np.ndarray] | None = None

    def find(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of keys are frequent, and their places."""
        own = self.keys[kind]
        at = np.minimum(np.searchsorted(own, keys), max(len(own) - 1, 0))
        return (own[at] == keys if len(own) else np.zeros(len(keys), bool)), at


def _often(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            b = opened(data.as_py(), width)
            for kind, keys, where in ((0, b.keys, b.word), (1, b.pair_keys, b.pair)):
                often = keys[np.bincount(where, minlength=len(keys)) >= FREQUENT].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(often), pa.int32()), pa.array(often)], ["kind", "key"])


def common(blocks: DataFrame, width: int) -> Common:
    """The frequent keys of some blocks, the COMMON most widespread ones at most."""
    some = [r["block"] for r in blocks.select("block").orderBy(F.xxhash64("block"), "block").limit(LOOKED_AT).collect()]
    rows = blocks.where(F.col("block").isin(some)).select("docs").mapInArrow(partial(_often, width=width), "kind int, key long")
    spread = rows.groupBy("kind", "key").agg(F.count("*").alias("n")).where(F.col("n") * 2 >= len(some))
    found = spread.orderBy(F.desc("n"), "kind", "key").limit(COMMON).toArrow()
    kind, key = found.column("kind").to_numpy(), found.column("key").to_numpy().view(np.uint64)
    return Common((np.sort(key[kind == 0]), np.sort(key[kind == 1])))


REQUEST = "block long, kind int, shard int, keys binary, counts binary"
WORDS, PAIRS = 0, 1  # kinds; 2 more: the sums of frequent ones, in slices


def _requests(batches: Iterator[pa.RecordBatch], bits: int, width: int, shared) -> Iterator[pa.RecordBatch]:
    names, frequent = [x.split()[0] for x in REQUEST.split(", ")], shared.value
    own = [np.zeros(len(k), np.int64) for k in frequent.keys]

    def rows(block: int | None, kind: int, shards: list[int], keys: list[bytes | None], counts: list[bytes]) -> pa.RecordBatch:
        n = len(shards)
        return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(shards, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names)

    for batch in batches:
        for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            b = opened(data.as_py(), width)
            learn = b.docs.column("learn").to_numpy()[b.doc]
            for kind, keys, where, length in ((WORDS, b.keys, b.word, 64), (PAIRS, b.pair_keys, b.pair, width)):
                counts = np.bincount(where[learn], minlength=len(keys))
                often, at = frequent.find(kind, keys)
                own[kind][at[often]] += counts[often]
                keys, counts = keys[~often], counts[~often]
                shard = (keys >> np.uint64(length - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                shards, starts = np.unique(shard, return_index=True)
                spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True)) if len(keys) else []
                yield rows(number, kind, shards.tolist(), [pack_sorted(keys[s:e]) for s, e in spans], [pack(counts[s:e]) for s, e in spans])
            del b, keys, where, counts, often, at, shard, learn  # before the next block is opened
    for kind, sums in enumerate(own):
        parts = [sums[i : i + SLICE] for i in range(0, len(sums), SLICE)]
        yield rows(None, kind + 2, list(range(len(parts))), [None] * len(parts), list(map(pack, parts)))


ANSWER = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("counts", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])


def _answers(requests: pa.Table) -> pa.Table:
    """To each block: the counts in all blocks of the keys that it asks for, in its order. And one row, of no block,
    with the shard's sum and its number of counted keys. Of frequent keys the one row has the sums, too."""
    kind, shard = requests.column("kind")[0].as_py(), requests.column("shard")[0].as_py()
    if kind >= 2:
        total = np.zeros(len(unpack(requests.column("counts")[0].as_py())), np.int64)
        for part in requests.column("counts"):
            total += unpack(part.as_py()).astype(np.int64)
        row = {"block": None, "kind": kind, "shard": shard, "counts": pack(total), "tokens": int(total.sum()), "types": int((total > 0).sum())}
        return pa.Table.from_pylist([row], schema=ANSWER)
    keys = [unpack_sorted(k.as_py()) for k in requests.column("keys")]
    counts = np.concatenate([unpack(c.as_py()) for c in requests.column("counts")]).astype(np.float64)
    known, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which, weights=counts, minlength=len(known)).astype(np.int64)
    out = np.split(total[which], np.cumsum([len(k) for k in keys])[:-1])
    n = len(keys) + 1
    return pa.Table.from_arrays(
        [pa.array([*requests.column("block").to_pylist(), None], pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array([*map(pack, out), None], pa.binary())]
        + [pa.array([None] * (n - 1) + [v], pa.int64()) for v in (int(total.sum()), int((total > 0).sum()))],
        schema=ANSWER,
    )


def counts_of(b: Block, answers: pa.Table, frequent: Common) -> tuple[np.ndarray, np.ndarray]:
    """Counts of b.keys and of b.pair_keys."""
    rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "shard", "counts")), strict=True))
    both = []
    for kind, keys in ((WORDS, b.keys), (PAIRS, b.pair_keys)):
        often, at = frequent.find(kind, keys)
        told = np.concatenate([np.empty(0, np.uint64), *(unpack(r[2]) for r in rows if r[0] == kind)]).astype(np.int64)
        if len(told) != (~often).sum():
            raise ValueError("a block's answers are not those to its requests")
        counts = np.empty(len(keys), np.int64)
        counts[~often] = told
        counts[often] = frequent.counts[kind][at[often]]
        both.append(counts)
    return both[0], both[1]


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)


GRID = "bucket int, f2 int, f1 int, n long, sum2 double, sum1 double"


def _held_out(blocks: pa.Table, answers: pa.Table, tokens: int, width: int, shared) -> pa.Table:
    """Of a block's tuning documents: how often each bucket meets each pair of estimates, to a step, by the counts
    less those of the document itself."""
    b = opened(blocks.column("docs")[0].as_py(), width)
    of_word, of_pair = counts_of(b, answers, shared.value)

    def own(where: np.ndarray) -> np.ndarray:
        _, at, n = np.unique(b.doc * (max(len(b.keys), len(b.pair_keys)) + 1) + where, return_inverse=True, return_counts=True)
        return n[at]

    # a document has each of its tokens once as what comes before another
    context = np.maximum(of_word[b.before] - own(b.before), 0)
    pair, word = np.maximum(of_pair[b.pair] - own(b.pair), 0), np.maximum(of_word[b.word] - own(b.word), 0)
    f2 = np.where(context > 0, pair / np.maximum(context, 1), 0)
    f1 = word / np.maximum(tokens - np.bincount(b.doc)[b.doc], 1)
    step = lambda f: np.where(f > 0, 1 + (-np.log2(np.where(f > 0, f, 1)) * STEPS).astype(np.int64), 0)
    cell, at, n = np.unique(np.stack([bucket(context), step(f2), step(f1)]), axis=1, return_inverse=True, return_counts=True)
    columns = [*cell, n, np.bincount(at, f2), np.bincount(at, f1)]
    kinds = [pa.int32()] * 3 + [pa.int64(), pa.float64(), pa.float64()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in GRID.split(", ")])


def weights(grid: pd.DataFrame, types: int) -> np.ndarray:
    """Per bucket the weights of bigram, unigram and even estimates, by expectation-maximisation. A bucket without
    held-out tokens has those of all buckets."""
    n = grid["n"].to_numpy(float)
    f = np.stack([grid["sum2"] / n, grid["sum1"] / n, np.full(len(n), 1 / (types + 1))], 1) if len(n) else np.zeros((0, 3))

    def learned(rows: np.ndarray) -> np.ndarray:
        mix = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            part = f[rows] * mix
            share = (n[rows, None] * part / part.sum(1, keepdims=True)).sum(0) + 1e-3
            mix = share / share.sum()
        return mix

    where = grid["bucket"].to_numpy()
    common = learned(np.arange(len(n))) if len(n) else np.array([0.5, 0.45, 0.05])
    out = np.array([learned(at) if len(at := np.flatnonzero(where == k)) else common for k in range(BUCKETS)])
    out[0] = [0, out[0, 1] + out[0, 0] / 2, out[0, 2] + out[0, 0] / 2]  # nothing has been seen after such a token
    return out


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scores(blocks: pa.Table, answers: pa.Table, tokens: int, types: int, mix: np.ndarray, width: int, shared) -> pa.Table:
    b = opened(blocks.column("docs")[0].as_py(), width)
    of_word, of_pair = counts_of(b, answers, shared.value)
    n, known = b.docs.num_rows, of_word > 0
    by_doc = partial(np.bincount, b.doc, minlength=n)
    base = np.log10((of_word + 1) / (tokens + types + 1))
    context = of_word[b.before]
    w = mix[bucket(context)]
    f2 = of_pair[b.pair] / np.maximum(context, 1)
    p = w[:, 0] * f2 + w[:, 1] * (of_word / max(tokens, 1))[b.word] + w[:, 2] / (types + 1)
    columns = [b.docs.column("doc_id"), b.docs.column("held_out"), pa.array(by_doc(), pa.int64()), pa.array(by_doc(weights=known[b.word]).astype(np.int64)), pa.array([tokens] * n, pa.int64())]
    return pa.Table.from_arrays([*columns, pa.array(by_doc(weights=base[b.word])), pa.array(by_doc(weights=np.log10(p)))], schema=SCORES)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def score(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    scratch = Scratch(docs.sparkSession, "lm")
    is_fold = lambda k: F.coalesce(fold(F.col("doc_id")) == k, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_fold(HELD_OUT).alias("held_out"), (F.col("doc_id").isNotNull() & ~is_fold(HELD_OUT)).alias("learn"), is_fold(TUNING).alias("tuning"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / BLOCK)))))
    width = min(64, max(48, int(np.ceil(np.log2(max(2, size)))) + 16))
    blocks = scratch.write(rows.mapInArrow(_packed, "block long, tuning boolean, docs binary"), "blocks")
    frequent = common(blocks, width)
    spark = docs.sparkSession
    requests = blocks.select("block", "docs").mapInArrow(partial(_requests, bits=bits, width=width, shared=spark.sparkContext.broadcast(frequent)), REQUEST)
    answers = scratch.write(requests.groupBy("kind", "shard").applyInArrow(_answers, "block long, kind int, shard int, counts binary, tokens long, types long"), "answers")
    totals = answers.where(f"block is null and kind in ({WORDS}, {WORDS + 2})").agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = totals[0] or 0, totals[1] or 0
    told = answers.where("kind >= 2").select("kind", "shard", "counts").orderBy("kind", "shard").collect()  # sums of at most COMMON keys
    frequent = frequent._replace(counts=tuple(np.concatenate([np.empty(0, np.int64), *(unpack(bytes(r["counts"])).astype(np.int64) for r in told if r["kind"] == kind + 2)]) for kind in (WORDS, PAIRS)))
    shared = spark.sparkContext.broadcast(frequent)
    replies = answers.where("block is not null").select("block", "kind", "shard", "counts")
    tuning = blocks.where("tuning")
    asked = replies.join(small(tuning.select("block"), 40), "block", "left_semi")
    grid = tuning.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(partial(_held_out, tokens=tokens, width=width, shared=shared), GRID)
    grid = grid.groupBy("bucket", "f2", "f1").agg(*[F.sum(c).alias(c) for c in ("n", "sum2", "sum1")]).toPandas()
    mix = weights(grid, types)
    pairs = blocks.groupBy("block").cogroup(replies.groupBy("block"))
    scored = partial(_scores, tokens=tokens, types=types, mix=mix, width=width, shared=shared)
    return pairs.applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
