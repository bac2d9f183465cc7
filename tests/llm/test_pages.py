import hashlib
import io
import math
import random
from collections import defaultdict

import pytest

from tests.llm.cases import CLASH, same
from tracklane.llm import style_tree, warc
from pyspark.sql import functions as F

ARTICLE = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li>'
           '</ul></nav><!-- x --><div class="ad">Buy</div><article><h1>Head &amp; more</h1><p><b>One\n  two<br>three<p>Four &lt;b&gt; &eacute;</p><aside>No</aside>'
           '<form>f</form><div class="comments"><p>nice</p></div></article><footer>&copy; f</footer></body></html>')
PAGES = [(1, "http://a.example/x", ARTICLE), (2, None, None), (3, "http://a.example/", ""), (4, "odd", "plain text"), (4, "odd", "plain text"),
         (5, "http://b.example", "<p>open <b>bold"), (None, "http://a.example/x", ARTICLE), (6, "http://c.example", "<p>x" * 20_000), (7, "https://U:p@A.example:80/q", ARTICLE)]


def pages(spark, rows=PAGES):
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    return d.withColumns({c: F.lit("clash") for c in CLASH if c not in d.columns})


def test_main_text(spark):
    text = "Head & more\n\nOne two three\n\nFour <b> é"
    got = style_tree.extract(pages(spark)).collect()
    want = {1: text, 2: "", 3: "", 4: "plain text", 5: "open bold", None: text, 6: "\n\n".join("x" * 20_000), 7: text}
    same([(r.page_id, r.text, r.n_chars) for r in got], [(p, want[p], len(want[p])) for p, _, _ in PAGES])
    assert style_tree.extract(pages(spark, [])).count() == 0


def test_entropy_removes_what_pages_of_a_host_share(spark):
    rows = [(i, f"http://s.example/{i}", f"<div><div class='top'>Welcome to the site</div><div class='body'><p>text number {i} of this page</p></div>"
             f"<div class='end'><span>All rights reserved</span></div></div>") for i in range(8)]
    rows += [(100 + i, "http://t.example/", "<div>one page only</div>") for i in range(9)]  # copies of one page say nothing
    got = {r.page_id: r.text for r in style_tree.extract(pages(spark, rows)).collect()}
    assert all(got[i] == f"text number {i} of this page" for i in range(8)) and got[103] == "one page only"


def main_texts(spark, make, n=8):
    rows = [(i, f"http://s.example/{i}", make(i)) for i in range(n)]
    return [r.text for r in sorted(style_tree.extract(pages(spark, rows)).collect(), key=lambda r: r.page_id)]


def test_side_words_in_names_of_content_drop_nothing(spark):
    page = ("<body class='has-sidebar'><div class='layout with-sidebar social'><h1>Title {0}</h1><article><h2 id='related-work'>Related {0}</h2>"
            "<h2 id='share'>Share {0}</h2><section id='share-price'><p>price {0} of this</p></section><div class='search-algorithms'>algorithm {0}</div>"
            "</article></div><div class='share'>Share it</div></body>")
    want = "Title {0}\n\nRelated {0}\n\nShare {0}\n\nprice {0} of this\n\nalgorithm {0}"
    assert main_texts(spark, page.format) == [want.format(i) for i in range(8)]
    assert main_texts(spark, page.format, 1) == [want.format(0)]
    plain = "<body class='has-sidebar'><div class='layout with-sidebar'><p>text {0} without main</p></div></body>"
    assert main_texts(spark, plain.format) == [f"text {i} without main" for i in range(8)]


def test_entropy_decides_in_articles_and_side_branches_hold(spark):
    page = ("<main><article><p>own text number {0}</p><div class='box7'><span>Buy our paper now</span></div><p>more of {0}</p></article></main>"
            "<section class='comments'><article><p>reader {0} says</p></article></section><aside><article>teaser {0}</article></aside>")
    assert main_texts(spark, page.format) == [f"own text number {i}\n\nmore of {i}" for i in range(8)]
    assert main_texts(spark, page.format, 2) == [f"own text number {i}\n\nBuy our paper now\n\nmore of {i}" for i in range(2)]
    # captures of one article that differ elsewhere: its text stays
    assert main_texts(spark, "<article><p>the one article</p></article><p>seen {0} times</p>".format)[3] == "the one article\n\nseen 3 times"


def test_a_form_around_the_page_is_no_side_branch(spark):
    page = "<body><form id='f'><h1>Title {0}</h1><p>the text of page {0}</p><form class='x'><p>your name</p></form></form></body>"
    assert main_texts(spark, page.format) == [f"Title {i}\n\nthe text of page {i}" for i in range(8)]


def test_deep_pages_take_linear_room():
    reach = style_tree.Settings().reach
    rows = list(style_tree._features("h", "<body>" + "<div class='a'><p>x" * 20_000, reach))
    assert len(rows) == 60_002 and max(len(r[-1]) for r in rows) == reach  # three features of each pair of nodes
    assert style_tree.Page("<p><button>" * 5000 + "<li>x").text(frozenset()) == "x"
    assert len(style_tree.Page("<p><table>" + "<div>x" * 20_000).text(frozenset())) == 60_000 - 2


def brute_noise(rows, settings):
    """Nodes of least importance by plain loops over whole chains of labels, every ancestor counted."""
    seen, weights = defaultdict(lambda: defaultdict(lambda: defaultdict(int))), {}
    for host, html in set(rows):
        for n in style_tree.Page(html).nodes:
            chain, a = [], n
            while a is not None:
                chain.insert(0, a.label)
                a = a.above
            if n.role != 0:
                at = (host, *chain)
                weights[at] = max(weights.get(at, 0), n.weight * (2.0 if n.role == 1 else 1.0))
                seen[at]["look", " ".join(n.children)][html] += 1
                for c in n.content:
                    seen[at]["text", c][html] += 1
    own, pages = {}, {}
    for at, features in seen.items():
        looks = [len(x) for (k, _), x in features.items() if k == "look"]
        m = pages[at] = max(sum(looks), max(map(len, features.values())))
        spread = [-sum(c / sum(x.values()) * math.log(c / sum(x.values())) for c in x.values()) for (k, _), x in features.items() if k == "text"]
        if m < settings.min_pages:
            own[at] = 1.0
            continue
        look = -sum(c / sum(looks) * math.log(c / sum(looks)) for c in looks) / math.log(m)
        own[at] = max(look, 1 - min(1, sum(spread) / len(spread) / math.log(m))) if spread else look
        own[at] = min(1.0, max(0.0, own[at]))
    noise = set()
    for at in own:
        best = max(0.9 ** (len(b) - len(at)) * own[b] * weights[b] for b in own if b[:len(at)] == at)
        if min(1, best) < settings.threshold and pages[at] >= settings.min_pages:
            key = 0
            for label in at[1:]:
                key = style_tree._number(label, key)
            noise.add((at[0], key))
    return noise


@pytest.mark.parametrize("seed", range(3))
def test_importance_equals_plain_loops(spark, seed):
    r = random.Random(seed)

    def part(depth):
        tag = r.choice(["div", "p", "span", "section", "article", "ul"])
        name = r.choice(["", " class='a'", " class='b'", " class='share-box'", " class='related'"])
        inner = "".join(part(depth - 1) for _ in range(r.randint(0, 3))) if depth else ""
        return f"<{tag}{name}>{r.choice(['same words', f'own {r.random()}', ''])}{inner}</{tag}>"

    fixed = [part(3) for _ in range(3)]
    deep = "<div>" * 30 + "<p>own {0}" + "</div>" * 30
    rows = [(f"h{i % 2}", "".join([r.choice(fixed), part(2), fixed[0], deep.format(i)])) for i in range(24)]
    rows += rows[:5]
    settings = style_tree.Settings()
    got = style_tree.importance(spark.createDataFrame(rows, "host string, html string"), settings).collect()
    got = {(x.host, x.node) for x in got if x.importance < settings.threshold and x.pages >= settings.min_pages}
    assert got == brute_noise(rows, settings) and got


def test_archives(spark):
    got = warc.read(warc.write(pages(spark), max_archive=300)).collect()
    first = {}
    for p, _, h in PAGES:
        h = (h or "").encode()
        if len(h) >= 100 and p is not None:
            first[h] = min(p, first.get(h, p))
    want = []
    for p, _, h in PAGES:
        h = (h or "").encode()
        f = first.get(h)
        want.append((p, len(h), hashlib.sha256(h).hexdigest(), "revisit" if f is not None and f != p else "response", f if f is not None and f != p else None))
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], want)
    assert warc.read(warc.write(pages(spark, []))).count() == 0


def test_reader_is_sequential_and_notices_damage():
    def rec(i, body):
        return warc.member(warc.record(i, f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), None, False))

    data = rec(1, b"a" * 200_000) + rec(2, b"\r\n\r\n") + rec(3, b"")
    got = [warc.page_of(r) for r in warc.read_records(io.BytesIO(data))]
    assert [(x[0], x[2]) for x in got] == [(1, 200_000), (2, 4), (3, 0)]
    with pytest.raises(warc.Damaged):
        list(warc.read_records(io.BytesIO(data[:-3])))
    raw = warc.record(1, "u", b"body", hashlib.sha256(b"body").hexdigest(), None, False)
    for bad in (raw.replace(b"body", b"bodi"), raw[:-1], raw + b"x", raw.replace(b"WARC/1.1", b"HTTP/1.1")):
        with pytest.raises(warc.Damaged):
            list(warc.read_records(io.BytesIO(warc.member(bad))))
    wrong = warc.record(1, "u", b"body", "0" * 64, None, False)
    with pytest.raises(warc.Damaged):
        [warc.page_of(r) for r in warc.read_records(io.BytesIO(warc.member(wrong)))]
