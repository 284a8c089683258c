"""Main text of web pages as a maximum-scoring subsequence, by weights learned from labelled pages.

A page is a sequence of words, which score above zero by how they stand, and of tags, which score below. A linear scan
finds the contiguous run of highest total score, which is the content region. A second one leaves out of the run the
places in it, such as an advert between paragraphs, whose own total is below zero. What is left is returned block by
block.

All weights are log odds learned from labelled pages, those that mark their content by an article or main element: of
words by their kind of block, links and length of their run; of tags by name; and of places, the names of sections,
classes, ids and roles that words stand in. The tag that opens a place costs CHARGE times its weight, if that is below
zero, for each word in it, or what a place around it costs, if that is more. Names that usually mean places beside the
content have a prior, which pages can outweigh; those that mean much else too have it only where the words beside them
are such names or parts of a layout. The label is used for learning alone; labelled and other pages are scored alike.
Where the run holds no word but headings, the place that holds the most text was named misleadingly and costs nothing.

Scripts, styles, controls of forms and hidden elements are dropped outright. Character references are decoded; white
space inside a block becomes one space; blocks are trimmed and joined by one newline. Null, empty or wordless pages
give an empty text. Long pages are scanned whole. Repeated rows give equal texts; extra columns pass through.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import small_batches

#: Most pages that the weights are learned from, those of the smallest hash.
LABELLED = 20_000
#: Most names of words, tags and places whose weights are kept, the most frequent ones.
NAMED = 3000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select canvas audio video".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split())
SPACED = frozenset("br td th".split())
CONTENT = frozenset(("article", "main"))
FRAMES = ("nav", "header", "footer", "form")
CONTROLS = frozenset("button datalist".split())
#: Elements, roles and words of class and id that usually mean a place beside the content.
PLACES = frozenset("nav footer aside form header dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner
    cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup paywall
    sidebar aside nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead topbar toolbar pagination pager
    comment comments disqus reply replies respond feedback share sharing social related recommended recommendations
    widget widgets login search skip copyright disclaimer hidden""".split()
)
#: Of NAMES, those that mean such a place only beside other names of it or parts of a layout.
LOOSE = frozenset("related recommended recommendations share sharing social header widget widgets notice notices notification hidden search promotion banner alert copyright disclaimer skip subscription advertising".split())
LAYOUT = frozenset(
    """area articles bar block bottom box button buttons col column container content count group icon icons image inner item items
    left link links list main media module outer page panel post posts right row section site slot thread title top unit wrap wrapper zone""".split()
) - {"image"}
PRIOR, CHARGE = -2.5, 2.0

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Of NAMES, those that the id of a part of a text may be made from.
TOPICS = frozenset("advertising promotion notice notices subscription navigation discussion sharing search copyright disclaimer hidden".split())
HAS = re.compile(r"(?<![a-z0-9])(?:has|with|without|no)[-_]\S*")

_QUOTED = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_QUOTED})>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/][^>]*\Z|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Item(NamedTuple):
    """A tag, or a run of text in one place."""

    tag: str  # of a run: the block that it stands in
    text: str | None
    words: int
    node: int  # the place
    label: bool  # in an article or main element
    linked: bool


class Node(NamedTuple):
    """A place: an element with a name, in another place. Node 0 is the page."""

    parent: int
    names: tuple[str, ...]
    dropped: bool


@lru_cache(maxsize=20_000)
def names_of(tag: str, attributes: str) -> tuple[tuple[str, ...], bool]:
    """The names that an element gives to its place, and whether it is dropped outright."""
    names = {f"tag {tag}"} if tag in PLACES else set()
    dropped = tag in CONTROLS
    if tag in ("html", "body", "main"):
        return (), False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            if name == "id" and tag in HEADINGS:
                continue
            # what an element has, as in has-sidebar, isn't what it is; a section's id may be made from its heading
            whole = tag == "article" or name == "id" and tag == "section"
            words = set(value.split() if whole else re.split(r"[^a-z0-9]+", HAS.sub("", value))) - {""}
            if not whole:
                words -= {w for part in value.split() for own in [re.split(r"[^a-z0-9]+", part)] for w in own if w in LOOSE and not all(x in NAMES or x in LAYOUT or x.isdigit() or not x for x in own)}
            names |= {f"name {w}" for w in (words - TOPICS if name == "id" and tag == "section" else words)}
        elif name == "role":
            names.add(f"role {value}")
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and INVISIBLE.search(value):
            dropped = True
    return tuple(sorted(names)), dropped


def items(page: str) -> tuple[list[Item], list[Node]]:
    out: list[Item] = []
    nodes = [Node(0, (), False)]
    stack: list[tuple[str, int]] = []  # open elements, each with the place around it
    opened: Counter = Counter()  # of each tag, so that the stack is not searched for one that isn't there
    node = labels = links = 0
    block = "body"

    def close(depth: int) -> None:
        nonlocal node, labels, links
        while len(stack) > depth:
            tag, node = stack.pop()
            opened[tag] -= 1
            labels -= tag in CONTENT
            links -= tag == "a"

    at, scan = 0, TOKEN.match
    while at < len(page) and (m := scan(page, at)):
        at = m.end()
        if (text := m[7]) is not None:
            text = html.unescape(text)
            out.append(Item(block, text, len(text.split()), node, labels > 0, links > 0))
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ends, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if ends:
            if opened[tag]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
        elif tag in RAW:
            if not attributes.endswith("/"):
                found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = found.end() if found else len(page)
        else:
            if tag in BLOCKS and opened["p"]:  # ends an open paragraph
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] in BLOCKS:
                        break
            if tag in CONTENT and any(opened[x] for x in FRAMES):  # isn't part of a menu that was never closed
                close(next(i for i, x in enumerate(stack) if x[0] in FRAMES))
            if tag == "li" and opened["li"]:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ("li", "ul", "ol", "menu")), None)
                if depth is not None and stack[depth][0] == "li":
                    close(depth)
            if tag not in VOID and not attributes.endswith("/"):
                names, dropped = names_of(tag, attributes)
                dropped |= tag == "label" and opened["form"] > 0
                if tag == "header" and (opened["article"] or opened["main"] or opened["section"]):  # that of a text
                    names = tuple(n for n in names if n not in ("tag header", "name header"))
                stack.append((tag, node))
                if names or dropped:
                    nodes.append(Node(node, names, dropped or nodes[node].dropped))
                    node = len(nodes) - 1
                opened[tag] += 1
                labels += tag in CONTENT
                links += tag == "a"
        if tag in BLOCKS:
            block = "body" if ends else tag
        out.append(Item(tag, None, 0, node, labels > 0, links > 0))
    return out, nodes


def feature(item: Item) -> str:
    """What a word's weight depends on."""
    kind = "h" if re.fullmatch(r"h[1-6]", item.tag) else item.tag if item.tag in ("p", "li", "pre", "blockquote", "table", "tr") else "other"
    length = min(3, int(math.log2(item.words + 1) / 2))
    return f"{'link' if item.linked else 'text'} {kind} {length}"


class Weights(NamedTuple):
    words: dict[str, float]
    tags: dict[str, float]
    places: dict[str, float]


def usual() -> Weights:
    """What holds without any labelled page."""
    return Weights({}, {}, {})


def word_weight(item: Item, weights: Weights) -> float:
    return weights.words.get(feature(item), 0.2 if item.linked else 1.0)


def prior(name: str) -> float:
    kind, _, value = name.partition(" ")
    return PRIOR if value in {"tag": PLACES, "role": ROLES, "name": NAMES}[kind] else 0.0


def weigh(counts: dict[tuple[str, str], tuple[float, float]]) -> Weights:
    """Weights from how many words of each feature and place, and tags of each name, stand inside and outside of
    labelled content. Words: log odds, between 0.1 and 3. Tags: between -0.4 and -0.02, the lower the more they belong
    outside, but so that a list can end a text although most lists are menus. Places: how much likelier a word inside is to stand there than one outside, as a logarithm between -4 and
    2, and the prior; both sides with 50 words of the usual mixture."""
    inside = sum(v[0] for k, v in counts.items() if k[0] == "word") + 1
    beside = sum(v[1] for k, v in counts.items() if k[0] == "word") + 1
    share = inside / (inside + beside)
    words = {k[1]: max(0.1, min(3.0, math.log((v[0] + 1) / (v[1] + 1)))) for k, v in counts.items() if k[0] == "word"}
    tags = {k[1]: -max(0.02, min(0.4, math.log1p((v[1] + 0.1) / beside / ((v[0] + 0.1) / inside)) / 4)) for k, v in counts.items() if k[0] == "tag" and k[1] not in CONTENT}
    odds = lambda v: math.log((v[0] + 50 * share) / (v[1] + 50 * (1 - share)) * beside / inside)
    places = {k[1]: prior(k[1]) + max(-4.0, min(2.0, odds(v))) for k, v in counts.items() if k[0] == "place"}
    return Weights(words, tags, places)


def count(page: str) -> Counter:
    """(word, tag or place, its name, inside or outside) of a labelled page; nothing of another."""
    found, nodes = items(page)
    out: Counter = Counter()
    if any(i.label and i.words for i in found):
        around: list[frozenset[str]] = []
        for n in nodes:
            around.append(frozenset(n.names) | (around[n.parent] if around else frozenset()))
        for i in found:
            if nodes[i.node].dropped:
                continue
            if i.text is None:
                out["tag", i.tag, i.label] += 1
            elif i.words:
                out["word", feature(i), i.label] += i.words
                for name in around[i.node]:
                    out["place", name, i.label] += i.words
    return out


def _upward(nodes: list[Node], at: int) -> Iterator[int]:
    """A node and those around it, but for the page."""
    while at:
        yield at
        at = nodes[at].parent


def cost(node: Node, weights: Weights) -> float:
    """What a place costs for a word in it, by its own names."""
    return CHARGE * min(0.0, min((weights.places.get(name, prior(name)) for name in node.names), default=0.0))


def charges(nodes: list[Node], weights: Weights, spared: frozenset[int] = frozenset()) -> list[float]:
    """What each node costs for a word in it; those that are spared cost no more than what is around them."""
    out: list[float] = []
    for at, n in enumerate(nodes):
        own = 0.0 if at in spared else cost(n, weights)
        out.append(min(own, out[n.parent]) if at else own)
    return out


def score(item: Item, charge: list[float], weights: Weights) -> float:
    if item.text is None:
        return weights.tags.get(item.tag, -0.2)
    return item.words * (word_weight(item, weights) + charge[item.node])


def region(found: list[Item], nodes: list[Node], charge: list[float], weights: Weights) -> list[Item]:
    """The run of items with the highest score, without the text of places in it that score below zero."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for at, i in enumerate(found):
        if total <= 0:
            total, start = 0.0, at
        total += 0.0 if nodes[i.node].dropped else score(i, charge, weights)
        if total > best:
            best, span = total, (start, at + 1)
    run = found[slice(*span)]
    totals = [0.0] * len(nodes)
    for i in run:
        totals[i.node] += score(i, charge, weights)
    for at in range(len(nodes) - 1, 0, -1):
        totals[nodes[at].parent] += totals[at]
    out = [False] * len(nodes)
    for at, n in enumerate(nodes):
        out[at] = n.dropped or at > 0 and (out[n.parent] or charge[at] < charge[n.parent] and totals[at] < 0)
    return [i for i in run if i.text is None or not out[i.node]]


def extract(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    found, nodes = items(page)
    charge = charges(nodes, weights)
    content = region(found, nodes, charge, weights)
    if not any(i.words and i.tag not in HEADINGS for i in content):
        around: list[int] = []  # of each node: the nearest place with a cost, itself included
        for at, n in enumerate(nodes):
            around.append(at if cost(n, weights) < 0 else around[n.parent] if at else 0)
        held: Counter = Counter()
        for i in found:
            if i.words and not i.linked and around[i.node] and not nodes[i.node].dropped:
                held[around[i.node]] += i.words
        if held:
            place = min(held, key=lambda a: (-held[a], a))
            content = region(found, nodes, charges(nodes, weights, frozenset(_upward(nodes, place))), weights)
    blocks: list[str] = []
    held_: list[str] = []
    for i in content:
        if i.text is not None:
            held_.append(i.text)
        elif i.tag in BLOCKS:
            blocks.append(" ".join("".join(held_).split()))
            held_ = []
        elif i.tag in SPACED:
            held_.append(" ")
    blocks.append(" ".join("".join(held_).split()))
    return "\n".join(b for b in blocks if b)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for page in batch.column(0).to_pylist():
            total += count(page or "")
    keys = list(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], ["kind", "name", "inside", "n"]
    )


def fit(pages: DataFrame, most: int = LABELLED) -> Weights:
    """Weights from at most about `most` pages, sampled row by row, so that copies don't come in or stay out together.
    The NAMED most frequent names reach the driver; others keep the usual weight."""
    n = pages.count()
    if not n:
        return usual()
    sample = pages.where(F.pmod(F.xxhash64(*(c for c in ("page_id", "url", "html") if c in pages.columns)), F.lit(1 << 30)) < int(min(1.0, most / n) * (1 << 30))).select("html")
    sums = sample.mapInArrow(_counts, "kind string, name string, inside boolean, n long").groupBy("kind", "name").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b"))
    rows = sums.orderBy(F.desc(F.col("a") + F.col("b")), "kind", "name").limit(NAMED).collect()
    return weigh({(r["kind"], r["name"]): (r["a"], r["b"]) for r in rows}) if rows else usual()


def main_text(pages: DataFrame, weights: Weights, into: str = "text") -> DataFrame:
    """pages with the main text of html."""
    small_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([extract(p.as_py(), weights) for p in batch], pa.string())

    return pages.withColumn(into, text(F.col("html")))
