"""Personal data by a skip-chain conditional random field over the mentions of each document.

Mentions are what the base patterns find (email, ip, card, phone), which keep their kinds, and looser forms: numbers
however they are grouped, addresses with spelled or bracketed signs. Variables are the mentions, the entities that they
name (the same digits or address in a document, however written) and, for entities that differ by one edit or share
their end, what they have in common. Potentials join each mention to the next one of another entity (the chain), to
its entity and each entity to what it shares (the skips), so that far mentions of an entity get one label; a star in
place of all pairs makes edges linear in mentions. An entity that no base pattern finds is held to be personal data only against a prior
of OUTSIDE, to be overcome by links to others and by the words beside its mentions. Sum-product messages pass over
these loops for TURNS damped turns, all documents of a batch at once; a mention is labelled if its kind has more than
half of the belief.

The potentials of words beside, of neighbours and of entities are estimated from all documents: of each the different
entities are counted, so that copies of a document count once. Words beside are hashed to BESIDE buckets.

Null and empty texts have no spans. Rows stay as they are, repeated ones and those with null ids too, and each
document is labelled on its own, so that ties and order don't matter. Texts are read whole, in time linear in their
length. Further columns go along, but for one named like the result. An empty table stays empty.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(1, 5)
STATES = len(KINDS) + 1  # 0: none of them
#: Log odds of an entity that no base pattern finds, and the most that a word beside or a neighbour changes. What the
#: base patterns miss may be personal data all the same, so that being seen beside it counts little against.
OUTSIDE, BESIDE_FROM_TO, CHAIN_FROM_TO = -4.0, (-0.1, 3.0), (-0.1, 0.5)
#: Pairs of mentions of an entity, and of entities that share something, of one kind that count besides those seen.
SAME, ALIKE = 400, 400
#: Entities with the usual words beside that count besides those seen of a kind: what is rarely seen tells little.
PRIOR = 1000
BESIDE, NEAR = 4096, 40
TURNS, DAMPING, NEVER = 25, 0.5, -60.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_ANY = re.compile(r"[0-9@]|[\[({<] ?(?:at|AT) ?[\])}>]")

_DOT = r"(?: ?(?:\.|[\[({<] ?(?:\.|dot|DOT) ?[\])}>]) ?| (?:dot|DOT) )"
_AT = re.compile(rf"(?: ?@ ?| ?[\[({{<] ?(?:@|at|AT) ?[\])}}>] ?| (?:at|AT) )([A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*)")
_SPELLED_DOT = re.compile(_DOT)
_LOOSE_IP = re.compile(rf"(?<![0-9])[0-9]++(?:(?:{_DOT}|[ _-])[0-9]++){{3}}(?![0-9])")
_LOOSE_NUMBER = re.compile(r"\+?\(?[0-9]++(?:[ \t\n\r ().\-/_]{1,3}[0-9]++)*+")

Mention = tuple[int, int, int, tuple[int, ...], str, list[str]]  # start, end, kind (0: not by a base pattern), kinds that it can have, key, what it shares


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """kind, start and end of what the base patterns find: leftmost, not overlapping others of the kind."""
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((EMAIL, start, last := m.end()))
    out += [(IP, *m.span()) for m in _IP.finditer(text) if _octets(m[0]) is not None]
    out += [(CARD, *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(PHONE, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _octets(text: str) -> str | None:
    """The four numbers of text without leading zeros, if they are at most 255."""
    parts = [d.lstrip("0") or "0" for d in _DIGITS.findall(text)]
    return ".".join(parts) if len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) else None


def _number(digits: str) -> str:
    """The key of a number: without its country's code or trunk zero if it may be a phone's."""
    return f"n{digits[-10:] if len(digits) <= 12 else digits}"


def _number_kinds(digits: str) -> tuple[int, ...]:
    return (CARD,) * (13 <= len(digits) <= 19) + (PHONE,) * (7 <= len(digits) <= 15)


def _shared(key: str) -> list[str]:
    """What an entity has in common with others that are like it: a number with one digit left out, its last seven
    digits; an address' name with the first part of its domain."""
    if key[0] == "n":
        digits = key[1:]
        return sorted({f"d{digits[:i]}{digits[i + 1 :]}" for i in range(len(digits))} | {f"d{digits}"} if len(digits) >= 9 else set()) + [f"e{digits[-7:]}"]
    if key[0] == "m":
        name, _, domain = key[1:].partition("@")
        return [f"a{name}@{domain.partition('.')[0]}"]
    return []


def _mention(kind: int, start: int, end: int, text: str) -> Mention:
    if kind == EMAIL:
        key = f"m{text[start:end].lower()}"
    elif kind == IP:
        key = f"i{_octets(text[start:end])}"
    else:
        key = _number(_digits(text[start:end]))
    return start, end, kind, (kind,), key, _shared(key)


def mentions(text: str) -> list[Mention]:
    """All mentions of a text, by start. Looser forms don't overlap what the base patterns find, nor each other."""
    if not _ANY.search(text):
        return []
    out = [_mention(*span, text) for span in base_spans(text)]
    known = {m[4] for m in out}
    ends = {s for m in out for s in m[5]}
    rest, at = [], 0
    for start, end in sorted(m[:2] for m in out):
        rest.append(text[at:start])
        rest.append("\0" * (end - max(at, start)))
        at = max(at, end)
    rest = "".join([*rest, text[at:]])
    loose: list[Mention] = []
    for m in _AT.finditer(rest):
        start = m.start()
        while start and rest[start - 1] in _LOCAL:
            start -= 1
        key = f"m{rest[start : m.start()]}@{_SPELLED_DOT.sub('.', m[1])}".lower()
        sign = m[0][: m.start(1) - m.start()]
        if start < m.start() and (sign.lower() != " at " or _shared(key)[0] in ends):
            loose.append((start, m.end(), 0, (EMAIL,), key, _shared(key)))
    for m in _LOOSE_IP.finditer(rest):
        if (parts := _octets(m[0])) is not None and (f"i{parts}" in known or re.search(r"[\[({<]", m[0])):
            loose.append((*m.span(), 0, (IP,), f"i{parts}", []))
    for m in _LOOSE_NUMBER.finditer(rest):
        loose += _of_chain([(m.start() + d.start(), m.start() + d.end()) for d in _DIGITS.finditer(m[0])], m.start(), rest, known)
    at = 0
    for x in sorted(loose, key=lambda x: (x[0], -x[1])):
        if x[0] >= at:
            out.append(x)
            at = x[1]
    return sorted(out, key=lambda m: (m[0], m[1], m[2]))


def _of_chain(groups: list[tuple[int, int]], start: int, text: str, known: set[str]) -> Iterator[Mention]:
    """The numbers of a chain of groups of digits: those in it that are known, else all of it as one."""
    found, i = False, 0
    while i < len(groups):
        digits, best = "", None
        for j in range(i, len(groups)):
            digits += text[slice(*groups[j])]
            if len(digits) > 19:
                break
            if len(digits) >= 7 and _number(digits) in known:
                best = j, digits
        if best:
            key, found = _number(best[1]), True
            yield (start if i == 0 else groups[i][0]), groups[best[0]][1], 0, _number_kinds(best[1]), key, _shared(key)
            i = best[0]
        i += 1
    size = sum(b - a for a, b in groups)
    if not found and 7 <= size <= 19:
        digits = "".join(text[a:b] for a, b in groups)
        yield start, groups[-1][1], 0, _number_kinds(digits), _number(digits), _shared(_number(digits))


def _bucket(words: list[str]) -> int:
    return zlib.crc32(words[0].strip(".,;:!?\"'()[]{}<>|=").lower().encode("utf-8", "replace")) % BESIDE if words else 0


def _hash(key: str) -> int:
    return int.from_bytes(blake2b(key.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


MENTIONS = "array<struct<start: int, end: int, kind: tinyint, kinds: array<tinyint>, key: bigint, shared: array<bigint>, before: int, after: int>>"
SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"


def _of_text(text: str | None) -> list[dict]:
    out = []
    for start, end, kind, kinds, key, shared in mentions(text or ""):
        before, after = text[max(0, start - NEAR) : start].split()[-1:], text[end : end + NEAR].split()[:1]
        out.append({"start": start, "end": end, "kind": kind, "kinds": list(kinds), "key": _hash(key), "shared": [_hash(s) for s in shared], "before": _bucket(before), "after": _bucket(after)})
    return out


def _with(docs: DataFrame, column: str, into: str, kind: str, each) -> DataFrame:
    """docs without column, and with into, which each makes of the column of a batch."""
    rest = [c for c in docs.columns if c not in (column, into)]
    new = T.StructType.fromDDL(f"`{into}` {kind}").fields[0]
    made = to_arrow_type(new.dataType)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(each(batch.column(column)), made)], [*rest, into])

    return docs.select(*rest, column).mapInArrow(step, T.StructType([*[docs.schema[c] for c in rest], new]))


class Potentials:
    """Log potentials: of the words before and after (2 x BESIDE x STATES), of neighbours (STATES x STATES), of one
    entity's mentions and of entities that share something."""

    def __init__(self, beside: np.ndarray, chain: np.ndarray, same: float, alike: float):
        self.beside, self.chain, self.same, self.alike = beside, chain, same, alike

    def tables(self) -> np.ndarray:
        """By kind of edge: chain, mention and entity, entity and what it shares."""
        return np.stack([self.chain, self.same * np.eye(STATES), self.alike * np.eye(STATES)])


def fit(found: DataFrame, column: str = "mentions") -> Potentials:
    """Potentials from all documents' mentions; what comes to the driver is bounded by BESIDE and the kinds."""
    each = found.select(F.posexplode(column).alias("at", "m"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("m.before").alias("word")), F.struct(F.lit(1).alias("side"), F.col("m.after").alias("word"))))
    seen = each.select(sides.alias("s"), F.col("m.kind").alias("kind"), F.col("m.key").alias("key")).select("s.side", "s.word", "kind", "key").distinct()
    n = np.zeros((2, BESIDE, STATES))
    for r in seen.groupBy("side", "word", "kind").count().collect():
        n[r["side"], r["word"], r["kind"]] = r["count"]
    usual = (n.sum(2, keepdims=True) + 1) / (n.sum((1, 2), keepdims=True) + BESIDE)
    share = np.log((n + PRIOR * usual) / (n.sum(1, keepdims=True) + PRIOR))
    beside = np.clip(share - share[:, :, :1], *BESIDE_FROM_TO)

    pairs = found.select(F.explode(F.zip_with(F.slice(column, 1, F.greatest(F.size(column) - 1, F.lit(0))), F.slice(column, 2, F.greatest(F.size(column) - 1, F.lit(0))), lambda a, b: F.struct(a["kind"].alias("a"), b["kind"].alias("b"), a["key"].alias("x"), b["key"].alias("y")))).alias("p")).select("p.*").where("x <> y").distinct()
    m = np.ones((STATES, STATES))
    for r in pairs.groupBy("a", "b").count().collect():
        m[r["a"], r["b"]] += r["count"]
    chain = np.clip(np.log(m * m.sum() / m.sum(1, keepdims=True) / m.sum(0, keepdims=True)), *CHAIN_FROM_TO)

    sure = F.filter(column, lambda x: x["kind"] > 0)
    agree = lambda keys: _agreement(found.select(sure.alias("sure")), keys)
    same, alike = agree(lambda x: F.array(x["key"])), agree(lambda x: x["shared"])
    return Potentials(beside, chain, float(np.log((SAME + same[0]) / (1 + same[1]))), float(np.log((ALIKE + alike[0]) / (1 + alike[1]))))


def _agreement(found: DataFrame, keys) -> tuple[float, float]:
    """Of the keys that several sure mentions of a document have: the sum of the shares of their pairs that are of one
    kind, and of those that aren't; a key counts once."""
    flat = found.withColumn("doc", F.monotonically_increasing_id()).where(F.size("sure") > 1)
    flat = flat.select("doc", F.explode(F.flatten(F.transform("sure", lambda x: F.transform(keys(x), lambda k: F.struct(k.alias("key"), x["kind"].alias("kind")))))).alias("s")).groupBy("doc", "s.key", "s.kind").agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    of_doc = flat.groupBy("doc", "key").agg(F.sum(pairs(F.col("n"))).alias("equal"), F.sum("n").alias("n")).where("n > 1")
    of_key = of_doc.groupBy("key").agg(F.avg(F.col("equal") / pairs(F.col("n"))).alias("share"))
    row = of_key.agg(F.coalesce(F.sum("share"), F.lit(0.0)), F.coalesce(F.sum(1 - F.col("share")), F.lit(0.0))).first()
    return float(row[0]), float(row[1])


def graph(documents: list[list[dict]], p: Potentials) -> tuple[np.ndarray, np.ndarray]:
    """The field of documents: potentials of the variables, mentions first, and edges (from, to, kind)."""
    own: list[np.ndarray] = []
    edges: list[tuple[int, int, int]] = []
    n = sum(map(len, documents))
    further: list[np.ndarray] = []
    for doc in documents:
        first, last, entities = len(own), None, {}
        shares: dict[int, list[int]] = defaultdict(list)
        for m in doc:
            allowed = np.full(STATES, NEVER)
            allowed[[m["kind"]] if m["kind"] else [0, *m["kinds"]]] = 0
            at = len(own)
            own.append(allowed + p.beside[0, m["before"]] + p.beside[1, m["after"]])
            if at > first and m["key"] != last:
                edges.append((at - 1, at, 0))
            last = m["key"]
            if (entity := entities.get(m["key"])) is None:
                entity = entities[m["key"]] = n + len(further)
                further.append(np.array([0.0] + [OUTSIDE] * len(KINDS)))
                for s in m["shared"]:
                    shares[s].append(entity)
            if m["kind"]:
                further[entity - n] = np.zeros(STATES)
            edges.append((at, entity, 1))
        joined = set()
        for members in shares.values():
            if len(members) > 1 and tuple(members) not in joined:  # what the same entities share counts once
                joined.add(tuple(members))
                edges += [(e, n + len(further), 2) for e in members]
                further.append(np.zeros(STATES))
    return np.array([*own, *further]).reshape(-1, STATES), np.array(edges, np.int64).reshape(-1, 3)


def beliefs(own: np.ndarray, edges: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Each variable's belief after TURNS turns of sum-product messages."""
    a, b, kind = np.concatenate([edges, edges[:, [1, 0, 2]]]).T
    there = np.concatenate([tables[edges[:, 2]], tables[edges[:, 2]].swapaxes(1, 2)])  # of each direction
    back = np.roll(np.arange(len(a)), len(edges))
    message = np.zeros((len(a), STATES))
    for _ in range(TURNS):
        all_in = own.copy()
        np.add.at(all_in, b, message)
        x = (all_in[a] - message[back])[:, :, None] + there
        most = x.max(1, keepdims=True)
        new = np.log(np.exp(x - most).sum(1)) + most[:, 0]
        new -= new.max(1, keepdims=True)
        message = DAMPING * message + (1 - DAMPING) * new
    all_in = own.copy()
    np.add.at(all_in, b, message)
    out = np.exp(all_in - all_in.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def label(documents: list[list[dict]], p: Potentials) -> list[list[dict]]:
    """The spans of documents' mentions, by kind, then start."""
    own, edges = graph(documents, p)
    found = beliefs(own, edges, p.tables()) if len(own) else own
    out, at = [], 0
    for doc in documents:
        spans = []
        for m, belief in zip(doc, found[at : at + len(doc)], strict=True):
            kind = m["kind"] or int(belief.argmax()) * bool(belief.max() > 0.5)
            if kind:
                spans.append((kind, m["start"], m["end"], m["kind"] > 0))
        at += len(doc)
        out.append([{"kind": KINDS[k - 1], "start": s, "end": e, "base": b} for k, s, e, b in sorted(spans)])
    return out


def find(docs: DataFrame, column: str = "text", into: str = "spans") -> DataFrame:
    """docs without their text, and with the spans of personal data in it: kind, start and end in code points, and
    whether a base pattern finds it."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.write(_with(docs.drop(into), column, "mentions" if "mentions" not in docs.columns else "mentions__", MENTIONS, lambda texts: [_of_text(t) for t in texts.to_pylist()]), "mentions")
    made = found.columns[-1]
    return _with(found, made, into, SPANS, partial(_labelled, p=fit(found, made)))


def _labelled(found: pa.Array, p: Potentials) -> list[list[dict]]:
    return label(found.to_pylist(), p)


def joined(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summarised(spans: str = "spans") -> list[Column]:
    """Of what find() gives: how many spans of each kind the base patterns find, a digest of these, and all spans."""
    base = F.filter(spans, lambda s: s["base"])
    of_kind = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in KINDS]
    return [*counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans")]
