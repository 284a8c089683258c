"""Near-duplicates by banded MinHash, candidates verified by odd sketches and confirmed on full sets.

A document's set holds the hashes of its distinct shingles of five words. Documents with equal sets are one class.
Per class: HASHES MinHash samples; bands of some of them, by which similar classes meet in buckets; and an odd sketch,
a bitmap in which each sample flips one bit, so that the bits in which two sketches differ tell how many samples
differ. A pair that meets is a candidate if its sketches differ in few enough bits; candidates are confirmed on their
sets. Bands are as long as they can be for two classes of the asked similarity to fail to meet with a probability
under one in a million; the limit of differing bits lies more than five standard deviations above what that
similarity gives.

In a bucket only pairs with one leader are made at first, the member that has the most company over all of its bands,
which is likely what its copies were made from; and only those candidates are confirmed that could join two
components. Where a bucket then still holds several components, all pairs across them are tested: as candidates, if
it has at most SMALL members. The members of all larger ones are divided by rare shingles: of a class' set, in one
order of rarity over these members, the first n - ceil(n * similarity) + 1 shingles are its prefix, and two similar
sets share a shingle of both prefixes. So copies of one template, which share all but a few shingles that no other
has, fall apart into small groups, whatever the size of the bucket; groups of several components are compared, small
ones as candidates, larger ones in blocks of two sides. A block first compares sketches alone, which tell the members
that have a candidate in another component; only these meet again with their sets, in blocks of bounded bytes, which are
compared at once in numpy and emit no more links than join their components. So no link between different components of
classes that meet is lost, and no group emits all of its pairs.

Sets and classes are known by 64-bit hashes: of n different ones some two are taken for one with probability
n * n / 2**65. Null texts, and those without words, have empty sets and are linked with nothing. Shorter texts than
five words are one shingle. Rows with a null id join groups but never name one; a group of such rows alone has a null
component. Repeated rows are copies. Extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, small
from sparkloom.llm.tokens import mixed, slices, words_of

SHINGLE = 5
HASHES = 192
BITS = 512
#: Members of a bucket or group of which all pairs across components become candidates; and bytes of sets, and members,
#: of a side of a block in a larger one.
SMALL, SIDE_BYTES, SIDE = 8, 8 << 20, 400
#: Bytes of text that are handled together.
BLOCK = 4 << 20

_random = np.random.default_rng(20240117)
_LOW, _HIGH = (_random.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint64).astype(np.uint32) | np.uint32(1) for _ in range(2))
_FLIP, _BAND = (_random.integers(0, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1) for _ in range(2))


def sets_of(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    number, sizes, hashes = words_of(texts)
    word = hashes[number]
    ends = np.cumsum(sizes)
    run, starts = word.copy(), ends - sizes
    for i in range(1, SHINGLE):
        run[: len(run) - i] = mixed(run[: len(run) - i], word[i:])
    out = []
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        if end - start >= SHINGLE:
            out.append(np.unique(run[start : end - SHINGLE + 1]))
        elif end > start:
            one = reduce(mixed, np.split(word[start:end], end - start))
            out.append(mixed(one, np.array([end - start], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def samples(shingles: np.ndarray) -> np.ndarray:
    """MinHash samples of a set that isn't empty."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096]
        low, high = part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, (_LOW * low + _HIGH * high).min(1), out=least)
    return least


def sketch(least: np.ndarray) -> np.ndarray:
    """The odd sketch, as signed 64-bit words."""
    at = (mixed(_FLIP, least.astype(np.uint64)) % np.uint64(BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def rows_of(percent: int) -> int:
    """Samples of a band."""
    miss = lambda r: (1 - (percent / 100) ** r) ** (HASHES // r)
    return max((r for r in range(1, 13) if miss(r) < 1e-6), default=1)


def most_bits(percent: int) -> int:
    """Most bits in which the sketches of two sets of this similarity differ, but once in some ten million pairs."""
    s, rest = percent / 100, 1 - 2 / BITS
    flips = 2 * HASHES * (1 - s)
    spread = (2 * rest**flips) ** 2 * HASHES * s * (1 - s) + 2 * flips**2 / BITS
    return round(BITS / 2 * (1 - rest**flips) + 5.5 * spread**0.5)


def bands(least: np.ndarray, rows: int) -> np.ndarray:
    n = len(least) // rows
    table = mixed(_BAND, least.astype(np.uint64))[: n * rows].reshape(n, rows)
    return reduce(mixed, table.T).view(np.int64)


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


SIGNED = "doc_id long, text_key long, n_shingles long, node long, sketch array<long>, bands array<long>"


def _signed(batches: Iterator[pa.RecordBatch], rows_: int) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    for batch in batches:
        for rows in slices(batch.column(2), BLOCK):
            part = batch.slice(rows.start, rows.stop - rows.start)
            sets = sets_of(part.column(2))
            least = [samples(s) if len(s) else None for s in sets]
            columns = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([None if x is None else sketch(x) for x in least], longs),
                pa.array([None if x is None else bands(x, rows_) for x in least], longs),
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], [x.split()[0] for x in SIGNED.split(", ")])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch.column(0), BLOCK):
            sets = sets_of(batch.column(0)[rows])
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])


def _joined(members: pa.Table, percent: int) -> pa.Table:
    """Of the members (node, of, shingles) of two sides: links enough to join all components of `of` that any link
    joins. Intersections are counted by matrix products over the shingles that several members share."""
    node, of = members.column("node").to_numpy(), members.column("of").to_numpy()
    lists = members.column("shingles").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    names, column, n = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(node)), sizes)
    shared = n > 1
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(node), len(node)), np.float32)
    for start in range(0, int(shared.sum()), 2048):
        a, z = np.searchsorted(column, [start, start + 2048])
        part = np.zeros((len(node), 2048), np.float32)
        part[row[a:z], column[a:z] - start] = 1
        both += part @ part.T
    total = sizes[:, None] + sizes[None, :] - both
    x, y = np.nonzero(np.triu((100 * both >= percent * total) & (of[:, None] != of[None, :]), 1))
    root = {k: k for k in of.tolist()}

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    out = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        p, q = top(int(of[i])), top(int(of[j]))
        if p != q:
            root[p] = q
            out.append(sorted((int(node[i]), int(node[j]))))
    return pa.table({"a": pa.array([e[0] for e in out], pa.int64()), "b": pa.array([e[1] for e in out], pa.int64())})


def _near(members: pa.Table, percent: int) -> pa.Table:
    """The members (key, i, j, node, of, sketch) of two sides whose sketch is near that of another component's."""
    flips = members.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(members), -1)
    of = members.column("of").to_numpy()
    keep = [bool(((of != of[i]) & (np.bitwise_count(flips[i] ^ flips).sum(1) <= most_bits(percent))).any()) for i in range(len(members))]
    return members.drop_columns(["sketch"]).filter(pa.array(keep, pa.bool_()))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and component, the least node that it is linked with, of all ends of edges (a, b). Every turn a node
    takes the least label of its neighbours and then that label's own, so that turns grow with the logarithm of a
    component's extent."""
    both = scratch.write(edges.select("a", "b").union(edges.select("b", "a")), f"{name}_both")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), f"{name}_0")
    n, turn = labels.count(), 0
    few = partial(small, row_bytes=60, rows=n)
    while True:
        turn += 1
        seen = both.join(few(labels.withColumnRenamed("node", "a")), "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("m"))
        lower = labels.join(few(seen), "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        moved = scratch.write(lower.join(few(jump), "next").select("node", F.least("next", "further").alias("component"), (F.least("next", "further") != F.col("was")).alias("changed")), f"{name}_{turn}")
        scratch.drop(f"{name}_{turn - 1}")
        if not moved.where("changed").limit(1).count():
            scratch.drop(f"{name}_both")
            return moved.select("node", "component")
        labels = moved.select("node", "component")


def _differing(x: Column, y: Column) -> Column:
    return reduce(lambda a, b: a + b, (F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(BITS // 64)))


class Linker:
    """The run of one table: its scratch tables and the links confirmed so far."""

    def __init__(self, docs: DataFrame, percent: int):
        self.percent, self.scratch = percent, Scratch(docs.sparkSession, "near")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
        self.signed = self.scratch.write(self.docs.mapInArrow(partial(_signed, rows_=rows_of(percent)), SIGNED), "signed")
        classes = self.signed.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("one"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
        self.classes = self.scratch.write(classes, "classes")
        self.links: DataFrame | None = None
        self.of: DataFrame | None = None  # node, component
        self.turn = 0
        self.repeats: bool | None = None  # whether an id occurs twice with one text

    def crowds(self) -> DataFrame:
        """key, band number, node, members and leader of the buckets with several members."""
        postings = self.classes.select("node", F.posexplode("bands").alias("at", "key"))
        full = self.scratch.write(postings.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "full")
        met = self.scratch.write(postings.join(small(full, 60), "key"), "met")
        company = self.scratch.write(met.groupBy("node").agg(F.sum("members").alias("company")), "company")
        leaders = met.join(small(company, 60), "node").groupBy("key").agg(F.max(F.struct("company", "node")).alias("l")).select("key", F.col("l.node").alias("leader"))
        return self.scratch.write(met.join(small(leaders, 60, full.count()), "key"), "crowds")

    def candidates(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), each once: those whose sketches are near, with the count of differing bits."""
        self.turn += 1
        pairs = self.scratch.write(pairs.distinct(), f"pairs_{self.turn}")
        n = pairs.count()
        for c in "ab":
            pairs = self.classes.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}")).join(small(pairs, 200, n), c)
        near = pairs.select("a", "b", _differing(F.col("sketch_a"), F.col("sketch_b")).alias("bits")).where(F.col("bits") <= most_bits(self.percent))
        return self.scratch.write(near, f"candidates_{self.turn}")

    def labelled(self, pairs: DataFrame) -> DataFrame:
        """pairs with the components of both ends, where these differ."""
        if self.of is None:
            return pairs.withColumns({"of_a": F.col("a"), "of_b": F.col("b")})
        for c in "ab":
            pairs = pairs.join(small(self.of.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), 60), c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
        return pairs.where("of_a <> of_b")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """node and shingles of nodes (node), made again from a text of each; of repeated rows more than once."""
        self.turn += 1
        nodes = self.scratch.write(nodes.distinct(), f"nodes_{self.turn}")
        wanted = self.classes.join(small(nodes, 40), "node").select(F.coalesce("one.doc_id", F.lit(0)).alias("id"), F.col("one.doc_id").isNull().alias("no_id"), F.col("one.text_key").alias("text_key"))
        wanted = self.scratch.write(wanted, f"wanted_{self.turn}")
        texts = self.docs.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text_key", "text").join(small(wanted, 40), ["id", "no_id", "text_key"], "left_semi")
        return self.scratch.write(texts.select("text").mapInArrow(_sets, "node long, shingles array<long>"), f"sets_{self.turn}")

    def once(self, sets: DataFrame) -> DataFrame:
        """sets with each node once; they are shuffled for that only if rows of the table repeat."""
        if self.repeats is None:
            self.repeats = bool(self.signed.where("node is not null").groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count())
        return sets.dropDuplicates(["node"]) if self.repeats else sets

    def add(self, links: DataFrame) -> None:
        """Keeps confirmed links (a, b) and finds the components anew."""
        self.turn += 1
        self.links = self.scratch.write(links if self.links is None else links.union(self.links), f"links_{self.turn}")
        if self.links.limit(1).count():
            self.of = components(self.links, self.scratch, f"components_{self.turn}")

    def confirm(self, candidates: DataFrame) -> None:
        """Confirms candidates on full sets: first the nearest one of each class, then all that could still join two
        components."""
        sets = self.sets(candidates.select(F.col("a").alias("node")).union(candidates.select("b")))
        tried = None
        for _ in range(2):
            open_ = self.labelled(candidates)
            if tried is None:
                nearest = [open_.groupBy(f"of_{c}").agg(F.min(F.struct("bits", "a", "b")).alias("e")).select("e.a", "e.b") for c in "ab"]
                open_ = nearest[0].union(nearest[1]).distinct()
            else:
                open_ = open_.select("a", "b").join(tried, ["a", "b"], "left_anti")
            self.turn += 1
            tried = open_ = self.scratch.write(open_.select("a", "b"), f"open_{self.turn}")
            if not open_.limit(1).count():
                break
            left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
            both = F.size(F.array_intersect("set_a", "set_b"))
            all_ = F.size("set_a") + F.size("set_b") - both
            self.add(left.join(small(open_, 40), "a").join(right, "b").where(100 * both >= self.percent * all_).select("a", "b"))

    def mixed(self, crowds: DataFrame) -> DataFrame:
        """Of crowds (key, node, members) with a third member: those that hold several components, with each member's in
        the column of."""
        if self.of is None:
            members = crowds.withColumn("of", F.col("node"))
        else:
            members = crowds.join(small(self.of.withColumnRenamed("component", "of"), 60), "node", "left").withColumn("of", F.coalesce("of", "node"))
        several = members.where("members > 2").groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low <> high").select("key")
        self.turn += 1
        several = self.scratch.write(several, f"several_{self.turn}")
        return self.scratch.write(members.join(small(several, 40), "key"), f"mixed_{self.turn}")

    def pairs(self, crowds: DataFrame) -> DataFrame:
        """Pairs across the components of small buckets or groups."""
        few = crowds.where(F.col("members") <= SMALL)
        one, two = (few.select("key", F.col("node").alias(c), F.col("of").alias(f"of_{c}")) for c in "ab")
        return one.join(two, "key").where("a < b and of_a <> of_b").select("a", "b")

    def divided(self, crowds: DataFrame) -> DataFrame:
        """key, node, of and members of the groups of several components that the members of large buckets form by the
        shingles of their prefixes. Of groups with the same members there is one."""
        self.turn += 1
        turn = self.turn
        members = self.scratch.write(crowds.where(F.col("members") > SMALL).select("node", "of").distinct(), f"crowded_{turn}")
        shingles = self.once(self.sets(members.select("node"))).select("node", F.explode("shingles").alias("key"))
        often = self.scratch.write(shingles.groupBy("key").agg(F.count("*").alias("often")).where("often > 1"), f"often_{turn}")
        # shingles that no other member has come first in a prefix, and meet nobody
        shared = shingles.join(small(often, 40), "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("shared"))
        shared = shared.join(small(members, 40), "node").join(self.classes.select("node", F.col("n_shingles").alias("n")), "node")
        rest = (F.size("shared") - F.ceil(F.col("n") * self.percent / 100) + 1).cast("int")
        prefixes = shared.where(rest > 0).select("node", "of", F.explode(F.slice("shared", F.lit(1), rest)).alias("s")).select("s.key", "node", "of")
        prefixes = self.scratch.write(prefixes, f"prefixes_{turn}")
        self.scratch.drop(f"often_{turn}")
        same = F.bit_xor(F.xxhash64("node"))
        groups = prefixes.groupBy("key").agg(F.count("*").alias("members"), F.min("of").alias("low"), F.max("of").alias("high"), same.alias("same")).where("low <> high")
        groups = self.scratch.write(groups.groupBy("same", "members").agg(F.min("key").alias("key")).select("key", "members"), f"groups_{turn}")
        found = self.scratch.write(prefixes.join(small(groups, 40), "key"), f"divided_{turn}")
        self.scratch.drop(f"prefixes_{turn}", f"groups_{turn}")
        return found

    def compared(self, crowded: DataFrame) -> DataFrame:
        """Links across the components of groups (key, node, of), as many as join them. Members outside a group's
        largest component are compared with all of its members, in blocks of two sides; a side has at most about SIDE
        members and SIDE_BYTES of sets."""
        self.turn += 1
        turn = self.turn
        sized = crowded.join(self.classes.select("node", "n_shingles"), "node").select("key", "node", "of", (F.col("n_shingles") * 8).alias("bytes"))
        crowded = self.scratch.write(sized, f"compared_{turn}")
        parts = crowded.groupBy("key", "of").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
        largest, whole = F.max(F.struct("n", "of", "bytes")).alias("m"), [F.sum(c).alias(c) for c in ("n", "bytes")]
        sides = lambda n, size: F.greatest(F.ceil(n / SIDE), F.ceil(size / SIDE_BYTES)).cast("int")
        main = parts.groupBy("key").agg(largest, *whole).select("key", F.col("m.of").alias("main"), sides(F.col("n") - F.col("m.n"), F.col("bytes") - F.col("m.bytes")).alias("outer"), sides(F.col("m.n"), F.col("m.bytes")).alias("inner"))
        main = self.scratch.write(main, f"main_{turn}")
        hashed, outside = F.xxhash64("node", "key"), F.col("of") != F.col("main")
        side = F.when(outside, F.pmod(hashed, "outer")).otherwise(F.col("outer") + F.pmod(hashed, "inner")).cast("int")
        last = F.when(outside, F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1
        met = crowded.join(small(main, 60), "key").where("outer > 0").withColumns({"side": side, "other": F.explode(F.sequence(F.lit(0), last))})
        met = self.scratch.write(met.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "node", "of"), f"sides_{turn}")
        percent = self.percent

        def near(block: pa.Table) -> pa.Table:
            return _near(block, percent)

        def joined(block: pa.Table) -> pa.Table:
            return _joined(block, percent)

        block, sketches = ["key", "i", "j"], self.classes.select("node", "sketch")
        found = sketches.join(small(met, 80), "node").select(*block, "node", "of", "sketch").groupBy(*block).applyInArrow(near, "key long, i int, j int, node long, of long")
        found = self.scratch.write(found, f"near_{turn}")
        # members of one template meet by many shingles; of blocks with the same members one is enough
        same = found.groupBy(*block).agg(F.bit_xor(F.xxhash64("node")).alias("same"), F.count("*").alias("n")).groupBy("same", "n").agg(F.min(F.struct(*block)).alias("one"))
        once = self.scratch.write(found.join(small(same.select("one.*"), 60), block), f"blocks_{turn}")
        return self.once(self.sets(once.select("node"))).join(small(once, 80), "node").groupBy(*block).applyInArrow(joined, "a long, b long")

    def run(self) -> DataFrame:
        """doc_id, text_key, n_shingles, node, component and component_id of each row. Rows of one id with different
        texts may name two components alike; these differ in component."""
        crowds = self.crowds()
        star = crowds.where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
        self.confirm(self.candidates(star))
        mixed_ = self.mixed(crowds)
        if mixed_.where(F.col("members") > SMALL).limit(1).count():
            groups = self.divided(mixed_)
            few = self.candidates(self.pairs(groups))
            if few.limit(1).count():
                self.confirm(few)
            if groups.where(F.col("members") > SMALL).limit(1).count():
                open_ = self.mixed(groups.where(F.col("members") > SMALL).drop("of"))
                self.add(self.compared(open_.select("key", "node", "of")))
            mixed_ = self.mixed(crowds)
        rest = self.candidates(self.pairs(mixed_.where(F.col("node") != F.col("leader"))))
        if rest.limit(1).count():
            self.confirm(rest)
        named = self.classes.select("node", "least")
        if self.of is not None:
            named = named.join(small(self.of, 60), "node", "left").withColumn("component", F.coalesce("component", "node"))
            least = named.groupBy("component").agg(F.min("least").alias("component_id"))
            named = named.join(small(self.scratch.write(least, "least"), 60), "component").select("node", "component", "component_id")
        else:
            named = named.select("node", F.col("node").alias("component"), F.col("least").alias("component_id"))
        named = self.scratch.write(named, "named")
        found = self.signed.select("doc_id", "text_key", "n_shingles", "node").join(small(named, 80), "node", "left")
        return found.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and kept. Documents are linked whose sets' intersection is at
    least percent of their union; kept is the one that names its component."""
    found = Linker(docs, percent).run()
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs' rows, one of each component, and all rows with an empty set."""
    found = Linker(docs, percent).run()
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_key")
    keep = found.where("node is not null").groupBy("component").agg(F.min(order).alias("o"), F.count("*").alias("n"))
    keep = keep.select(F.col("o.id").alias("__id"), F.col("o.no_id").alias("__no_id"), F.col("o.text_key").alias("__text_key"))
    tagged = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__no_id": F.col("doc_id").isNull(), "__text_key": F.xxhash64("text")})
    wordless = tagged.where(F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    keys = ["__id", "__no_id", "__text_key"]
    kept = tagged.join(small(keep.distinct(), 64), keys, "left_semi")
    repeated = found.where("node is not null").groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count()
    if repeated:
        kept = kept.dropDuplicates(keys)
    return kept.select(*docs.columns).union(wordless.select(*docs.columns))
