"""WARC archives, main text and top-k search on odd rows, against brute force and fixed texts."""

import gzip
import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import extract, topk, warc
from sparkloom.llm.common import Scratch
from sparkloom.llm.queries import op4_extract, op7_topk

PAGES = "page_id long, url string, html string, payload string, type string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "p", "t", "x") for r in rows], PAGES).repartition(3)


def test_archives_round_trip(spark):
    rng = random.Random(3)
    big = "".join(rng.choice("abc é\r\n\r\n<>漢") for _ in range(60_000))
    copy, small = "same page " * 200, "tiny"
    rows = [(1, "http://a/1", big), (2, "http://a/2 x\r\ny", copy), (7, None, copy), (5, "u", copy), (8, "u", small), (9, "u", small), (10, "u", None), (11, "u", ""), (None, "u", copy), (None, "u", None), (12, "é", "WARC/1.1\r\n\r\n" + "z" * 2000), (12, "é", "WARC/1.1\r\n\r\n" + "z" * 2000)]
    found = warc.archived(pages(spark, rows))
    data = [(i, (h or "").encode()) for i, _, h in rows]
    want = Counter()
    for i, d in data:
        same = [j for j, e in data if e == d and j is not None]
        first = max(same) if len(d) >= 1000 and same else i
        want[i, len(d), hashlib.sha1(d).hexdigest(), "response" if i == first else "revisit", None if i == first else first] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found.collect()) == want
    assert warc.archived(pages(spark, [])).collect() == []


def test_archives_are_sound_and_the_same_again(spark, tmp_path):
    """Every file: gzip members of one record each, the first a warcinfo; ids are unique, revisits name a response's."""
    copy = "same page " * 200
    rows = [(i, f"u{i}", "own page " * 150 + str(i)) for i in range(20)] + [(100 + i, "u", copy) for i in range(5)] + [(7, "u", "x" * 40_000), (8, "u", "small"), (8, "u", "small")]
    rows += [(300, "u", "y" * 1500), (300, "v", "y" * 1500), (299, "v", "y" * 1500)]
    seen = []
    for run in ("a", "b"):
        warc.write(pages(spark, rows), str(tmp_path / run), Scratch(spark, "test"))
        found = []
        for file in sorted((tmp_path / run).glob("part-*")):
            data = file.read_bytes()
            assert gzip.decompress(data) == warc.unzipped(data)
            members, at = [], 0
            while at < len(data):
                member = zlib.decompressobj(31)
                members.append(member.decompress(data[at:]) + member.flush())
                at = len(data) - len(member.unused_data)
            kinds = [[f["warc-type"] for f, _ in warc.parse(m)] for m in members if m]
            assert all(len(k) == 1 for k in kinds) and kinds[0] == ["warcinfo"]
            found += [f for f, _ in warc.parse(data)]
        ids = [f["warc-record-id"] for f in found]
        responses = {f["warc-record-id"] for f in found if f["warc-type"] == "response"}
        assert len(set(ids)) == len(ids)
        revisits = [f for f in found if f["warc-type"] == "revisit"]
        assert len(revisits) == 5 and sum("warc-refers-to" in f for f in revisits) == 4
        assert all(f["warc-refers-to"] in responses for f in revisits if "warc-refers-to" in f)
        seen.append(sorted(ids))
    assert seen[0] == seen[1]


def test_segments_are_cut_and_found_missing():
    payload = bytes(range(256)) * 400
    parts = list(warc.records(1, "u", payload))
    assert len(parts) > 3 and sum(b"WARC-Type: continuation" in p for p in parts) == len(parts) - 1
    parsed = list(warc.parse(b"".join(p + warc.END for p in parts)))
    assert warc.payload_of(b"".join(block for _, block in parsed)) == payload
    with pytest.raises(ValueError):
        list(warc.parse(parts[0][:-5] + warc.END))
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_a_missing_segment_stops_reading(spark, tmp_path):
    parts = list(warc.records(1, "u", b"x" * 50_000))
    (tmp_path / "a.warc").write_bytes(b"".join(p + warc.END for p in parts if b"Segment-Number: 2" not in p))
    with pytest.raises(Exception, match="segment is missing"):
        warc.read(spark, str(tmp_path), Scratch(spark, "test")).collect()


PAGE = """<!DOCTYPE html><html><head><title>no title</title><style>p{}</style><script>var a="<p>no script</p>";</script></head>
<body><header><a href="/">no header</a></header><nav><ul><li>no menu</li></ul></nav><div class="cookie-notice">no notice</div>
<div id="sidebar"><p>no sidebar text that is long enough to look like an article of its own, more words than most</p></div>
<%s><h1>The   heading &amp; more</h1><p>First <b>bold</b>ness, with a
line break<br>and a link <a href="/x">kept in the text</a>.<div class="ad"><p>no advert</p></div><p>Second paragraph &eacute;t&eacute; &#233; &lt;tag&gt; with words enough to be an article.
<form><label>no form</label><button>no button</button></form><ul><li>one item</li><li>two items</li></ul></%s>
<section class="comments"><article class="comment"><p>no reader comment at all, however long it may be and however many words</p></article></section>
<aside>no aside</aside><footer>no footer &copy; 2024</footer></body></html>"""
TEXT = "The heading & more\nFirst boldness, with a line break and a link kept in the text.\nSecond paragraph été é <tag> with words enough to be an article.\none item\ntwo items"


@pytest.mark.parametrize("element", ["article", "main"])
def test_main_text_of_a_labelled_page(element):
    page = PAGE % (element, element)
    for weights in (extract.usual(), _learned([page])):
        assert extract.extract(page, weights) == TEXT
        assert extract.extract(page.replace("</body></html>", ""), weights) == TEXT


def _learned(pages):
    counts = sum((extract.count(p) for p in pages), Counter())
    return extract.weigh({k: (counts[*k, True], counts[*k, False]) for k in {k[:2] for k in counts}})


def test_main_text_without_a_label():
    page = PAGE % ("div class='content'", "div")
    for weights in (extract.usual(), _learned([PAGE % ("article", "article")])):
        assert extract.extract(page, weights) == TEXT


def test_weights_are_learned_and_decide(monkeypatch):
    """Places of unknown names beside labelled articles: what is learned of them holds for pages without a label, no
    list of names helps, and without weights, or with reversed ones, the text is another."""
    monkeypatch.setattr(extract, "prior", lambda name: 0.0)
    rng = random.Random(4)
    line = lambda n: " ".join(rng.choice("one two three four five six".split()) for _ in range(n))

    def page(element):
        want = [line(30), line(60)]
        html = f"<body><div class='zub'>{line(12)}</div><ul><li><a href='x'>{line(2)}</a><li><a>{line(1)}</a></ul><{element}><p>{want[0]}</p><p>{want[1]}</p></{element}><div class='krum'>{line(9)}</div></body>"
        return html, "\n".join(want)

    weights = _learned([page("article")[0] for _ in range(60)])
    assert weights.places["name zub"] < -1.5 and weights.words["text p 2"] > 1 > weights.words["link li 0"]
    flipped = extract.Weights(*({k: -v if kind == "places" else 3.1 - v if kind == "words" else -0.42 - v for k, v in getattr(weights, kind).items()} for kind in weights._fields))
    for element in ("article", "div", "section"):
        html, want = page(element)
        assert extract.extract(html, weights) == want
        assert extract.extract(html, extract.usual()) != want != extract.extract(html, flipped)


def test_a_list_can_end_a_text():
    """Of lists the labelled pages know menus alone."""
    menu = "<nav><ul><li><a href='/'>one</a></li><li><a href='/'>two</a></li></ul></nav>"
    weights = _learned([f"{menu}<article><p>{'some words ' * 20}</p></article><footer>the end</footer>"] * 100)
    assert weights.tags["li"] == -0.4
    page = f"{menu}<article><p>{'some words ' * 20}</p><ul><li>first</li><li>second item</li></ul></article><footer>the end</footer>"
    for html in (page, page.replace("article>", "div>")):
        assert extract.extract(html, weights) == ("some words " * 20).strip() + "\nfirst\nsecond item"


def test_the_scan_finds_the_best_run():
    """Against all runs, of random items and weights."""
    rng = random.Random(5)
    for _ in range(200):
        found = [extract.Item(rng.choice("ab"), rng.choice([None, None, "x"]), 0, 0, False, False) for _ in range(rng.randint(1, 12))]
        found = [i if i.text is None else i._replace(words=rng.randint(0, 3)) for i in found]
        weights = extract.Weights({}, {t: -rng.choice([0.5, 1.5, 2.25]) for t in "ab"}, {})
        score = lambda run: sum(weights.tags[i.tag] if i.text is None else i.words * extract.word_weight(i, weights) for i in run)  # noqa: E731, B023
        best = max(score(found[i:j]) for i in range(len(found) + 1) for j in range(i, len(found) + 1))
        assert score(extract.region(found, [extract.Node(0, (), False)], [0.0], weights)) == pytest.approx(best)


@pytest.mark.parametrize("where", ["inside", "after"])
def test_comments_marked_as_articles_are_not_main_text(where):
    comment = "<article class='comment'><p>no reader comment, however many words it may take to say so</p></article>"
    ends = f"{comment}</article>" if where == "inside" else f"</article>{comment}"
    page = f"<body><article class='post has-sidebar no-comments'><h1>Heading</h1><p>Some words of the article itself.</p>{ends}</body>"
    assert extract.extract(page, extract.usual()) == "Heading\nSome words of the article itself."


@pytest.mark.parametrize(
    "page",
    [
        "<article><h2 id='related-work'>Title words</h2><p>{0}</p></article>",
        "<article><h2>Title words</h2><section id='discussion'><p>{0}</p></section></article>",
        "<article><h2>Title words</h2><section id='full-text-search'><p>{0}</p></section></article>",
        "<div class='content with-sidebar'><h2>Title words</h2><p>{0}</p></div>",
        "<div class='col-main has-sidebar'><h2 id='how-to-share-files'>Title words</h2><p>{0}</p></div>",
    ],
)
def test_common_words_in_names_do_not_take_content_out(page):
    text = "some words of the text itself " * 20
    assert extract.extract(f"<html><body><nav>a menu</nav>{page.format(text)}</body></html>", extract.usual()) == f"Title words\n{text.strip()}"
    for mark in ("class='comments'", "class='comment-list'", "class='share-buttons'", "class='related-posts'", "id='sidebar-left'", "id='disqus_thread'"):
        assert extract.extract(f"<article><p>{text}</p><div {mark}><p>{text}</p></div></article>", extract.usual()) == text.strip()


@pytest.mark.parametrize(
    "page",
    [
        "<div class='site-content has-sidebar'>{0}</div>",
        "<div class='post with-comments'>{0}</div>",
        "<div class='social-history'>{0}</div>",
        "<section id='related-work'>{0}</section>",
        "<div title='the hidden truth' data-x='hidden'>{0}</div>",
        "<form id=aspnet><div class='banner'>no banner</div>{0}</form>",
        "<div class='related'><div class='search'>{0}</div></div>",
    ],
)
def test_a_misnamed_place_is_content_where_there_is_no_other(page):
    text = "some words of the text itself in a sentence " * 30
    want = text.strip()
    for weights in (extract.usual(), _learned([PAGE % ("article", "article")] * 50)):
        assert extract.extract(f"<html><body><nav><a href='/'>a menu</a></nav>{page.format(f'<p>{text}</p>')}<footer>no footer</footer></body></html>", weights) == want


def test_dropped_elements_are_never_content():
    text = "some words of the text itself in a sentence " * 30
    for mark in ("hidden", "style='display: none'", "aria-hidden='true'"):
        assert extract.extract(f"<p>short</p><div {mark}>{text}</div>", extract.usual()) == "short"


def test_tags_that_are_never_closed_cost_no_more_than_others():
    began = time.perf_counter()
    page = "<article>" + "<span>word</b> " * 40_000
    assert extract.extract(page, extract.usual()) == " ".join(["word"] * 40_000)
    assert time.perf_counter() - began < 10


def test_main_text_of_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<div><br></div>"), (4, "u", "plain words"), (5, "u", "<p>a < b && c <"), (6, "u", "<article>" + "<p>long text</p>" * 20_000), (6, "u", "<!-- only -- a comment"), (None, "u", "<script>never closed <p>x")]
    found = {(r["page_id"], r["html"]): r["main"] for r in extract.main_text(pages(spark, rows), extract.usual(), into="main").collect()}
    assert len(found) == len(rows)
    assert found[1, None] == found[2, ""] == found[3, "<div><br></div>"] == found[None, rows[-1][2]] == ""
    assert found[4, "plain words"] == "plain words" and found[5, rows[4][2]] == "a < b && c <"
    assert found[6, rows[5][2]] == "\n".join(["long text"] * 20_000)
    assert extract.fit(pages(spark, [])) == extract.usual()


def article_of(page):
    inside = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inside))]
    return "\n".join(b for b in blocks if b)


def test_main_text_of_the_pages_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in table.collect()}
    found = op4_extract(spark, sf_dir).collect()
    assert len(found) == len(source)
    assert all(r["text"] == article_of(source[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in found)
    weights = extract.fit(table)
    assert weights.words and weights.tags and weights.places
    for page in source.values():  # without the label, by what the labelled ones teach
        assert extract.extract(page.replace("article>", "div>"), weights) == article_of(page)


def test_the_scan_decides_on_the_pages_table(spark, sf_dir, monkeypatch):
    """Without it, as with names that no list holds, the text stays what the weights make of it."""
    source = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    weights = _learned(source)
    assert all(extract.extract(p, weights) == article_of(p) for p in source)
    odd = [re.sub(r"<(/?)(nav|footer)>", lambda m: f"<{m[1]}div{'' if m[1] else f' class=zq{len(m[2])}'}>", p).replace('class="ad"', 'class="krum"') for p in source]
    learned = _learned(odd)
    assert all(extract.extract(p.replace("article>", "div>"), learned) == article_of(s) for p, s in zip(odd, source, strict=True))
    monkeypatch.setattr(extract, "region", lambda found, nodes, charge, weights: [i for i in found if not nodes[i.node].dropped])
    assert not any(extract.extract(p, weights) == article_of(p) for p in source)


@pytest.mark.parametrize("opened", ['<section class="related-work">', '<div class="share-your-story">', '<div class="header-image">', '<div class="widget widget-text">', '<div id="discussion">', '<div class="notice-of-hearing">', '<div class="hidden-gems">', '<div class="social-history">', "<div><p>Some <label>word</label> of it</p>"])
def test_parts_of_a_text_with_names_that_mean_something_else(opened):
    line = ("some words of the text itself in a sentence " * 30).strip()
    part = "a further part of the text with words enough to be one"
    close = "</section>" if opened.startswith("<section") else "</div>"
    page = f"<html><body><nav><a href='/'>a menu</a></nav><article><h1>Title</h1><p>{line}</p>{opened}<p>{part}</p>{close}<p>{line}</p></article><footer>the end</footer></body></html>"
    want = ["Title", line, *(["Some word of it"] if "label" in opened else []), part, line]
    for weights in (extract.usual(), _learned([PAGE % ("article", "article")] * 50)):
        assert extract.extract(page, weights).split("\n") == want or "widget" in opened
    assert extract.extract(page, _learned([page] * 20)).split("\n") == want
    comments = page.replace(opened, '<div class="user-feedback">').replace("</section>", "</div>")
    assert part not in extract.extract(comments, extract.usual())


VECTORS = "vec_id long, embedding array<float>, rank int, score string"


def brute_top(rows, k=10):
    fine = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in sorted(fine, key=lambda r: r[1], reverse=True):
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in fine if i != q)[:k]
            out = {o for o in out if o[0] != q} | {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize("n", [0, 1, 6, 300])
def test_top_k(spark, n):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(n)]
    if n > 100:
        rows += [(900, rows[0][1]), (901, rows[0][1]), (902, None), (None, rows[1][1]), (1000, [1.0] * 7 + [None]), (1100, [float("nan")] * 8), (1200, [float("inf")] + [0.0] * 7), (1300, [0.0] * 8), (1400, [0.5] * 5)]
    df = spark.createDataFrame([(*r, 3, "s") for r in rows], VECTORS).repartition(3)
    found = topk.search(df, df.where("vec_id % 100 = 0"))
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()} == brute_top(rows)


def test_top_k_in_many_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.normal(size=4).astype(np.float32)]) for i in range(0, 900, 20)]
    df = spark.createDataFrame([(*r, 3, "s") for r in rows], VECTORS)
    found = topk.search(df, df.where("vec_id % 100 = 0"))
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()} == brute_top(rows)


def test_many_equal_vectors_leave_few_survivors(spark, monkeypatch):
    rng = np.random.default_rng(9)
    popular, rare = ([float(x) for x in rng.normal(size=6).astype(np.float32)] for _ in range(2))
    rows = [(i, popular) for i in range(5000)] + [(9000 + i, rare) for i in range(3)] + [(7, popular)] * 4 + [(9100, rare)] * 15
    rows += [(10_000 + i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(40)]
    df = spark.createDataFrame([(*r, 3, "s") for r in rows], VECTORS).repartition(3)
    written = {}
    write = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, table, name, *mode: written.setdefault(name, write(self, table, name, *mode)))
    found = topk.search(df, df.where("vec_id % 100 = 0"))
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()} == brute_top(rows)
    queries = written["queries"].count()
    assert written["survivors"].count() <= 42 * queries and written["first"].count() <= 20 * 11 * queries


def test_components_beyond_exact_doubles(spark):
    rng = np.random.default_rng(10)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=3) * 1e5]) for i in range(60)]
    df = spark.createDataFrame([(*r, 3, "s") for r in rows], VECTORS)
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(df, df.where("vec_id % 100 = 0")).collect()} == brute_top(rows)
    df = spark.createDataFrame([(1, [1e16], 0, ""), (100, [1e16], 0, "")], VECTORS)
    with pytest.raises(Exception, match="(?i)overflow"):
        topk.search(df, df.where("vec_id % 100 = 0")).collect()


def test_top_k_of_the_embeddings_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in op7_topk(spark, sf_dir).collect()} == brute_top(rows)
