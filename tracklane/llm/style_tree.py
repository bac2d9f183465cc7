"""Main text of pages by a site style tree.

Pages of a host are merged into one tree: a node is a chain of element labels (tag and classes) from the root, and
under it lie the sequences of children (presentation) and the texts, links and images (content) that pages have there. A
node whose pages all look and read alike is template; one whose pages differ is content. Presentation importance is the
entropy of the child sequences over the pages that have the node, content importance one less the mean entropy of its
features over pages; logarithms are to the base of the number of pages. The importance of a branch is that of its
best node, a tenth less with each level down. Branches below a threshold are removed from pages.

Some labels say what they are: elements for navigation, forms and the like, and those with a class, id or role that as a
whole is a word for such a part, have no importance, nor has what lies in them, articles too. Such a class, id or role
says nothing on a heading, on html, body, article and main, or on an element that holds the page's main heading or main
element and most of its text; nor does a form that is around the page like this. Headers in articles go with the other headers.
Other labels only weigh: importance is twice as much in an article or main element and half
as much below a class, id or role of which one part is a side word. Where all that a host's articles hold is alike, the
article stays as it is. Nodes that few distinct pages have cannot be told from content and stay. Exact copies of a page
count once.

The tree is never in one place: nodes and features are rows, aggregated with partial sums before each shuffle, so a
host that holds a third of all pages is no single task. A node's key is a hash of its parent's key and its label, and its
row names the ancestors that it can lift above the threshold, which the discount with each level makes few: rows stay
small and parsing linear however deep a page nests.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import batches, materialize, text_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
#: A start tag ends an open element of these kinds, unless one of the second lies between.
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, a, b in (
    ("li", "li p", "ul ol menu"), ("dt", "dt dd p", "dl"), ("dd", "dt dd p", "dl"), ("option", "option", "select"),
    ("tr", "tr td th p", "table"), ("td", "td th p", "table"), ("th", "td th p", "table"))}
UNSEEN = frozenset("head script style noscript template iframe object svg canvas select button textarea title".split())
SIDE_TAGS = frozenset("nav header footer aside form dialog menu".split())
MAIN_TAGS = frozenset("article main".split())
SIDE_WORDS = frozenset("""ad ads advert adverts advertisement banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs
    sidebar header footer masthead cookie cookies consent notice notices popup modal newsletter subscribe share sharing social related
    recommended comment comments reply replies disqus login signup search pagination pager""".split())
#: Elements whose class, id or role is no side word.
OWN_NAME = frozenset("#page html body article main h1 h2 h3 h4 h5 h6".split())
MAIN_WEIGHT, SIDE_WEIGHT = 2.0, 0.5
#: What a level makes of importance.
LEVEL = 0.9

FEATURES = pa.schema([("host", pa.string()), ("page", pa.int64()), ("node", pa.int64()), ("kind", pa.string()), ("feature", pa.int64()), ("n", pa.int64()),
                     ("weight", pa.float64()), ("up", pa.list_(pa.int64()))])
FEATURES_DDL = "host string, page long, node long, kind string, feature long, n long, weight double, up array<long>"
TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


class Settings(NamedTuple):
    """threshold: least importance of what stays; min_pages: distinct pages that a node needs to be judged."""

    threshold: float = 0.25
    min_pages: int = 4

    @property
    def reach(self) -> int:
        """Levels up to which a node of the greatest importance and weight can lift a branch to the threshold."""
        return int(math.log(self.threshold / MAIN_WEIGHT, LEVEL)) + 1 if 0 < self.threshold < MAIN_WEIGHT else 0


class Node:
    """side: the label says that the branch is a side one; weight: what the labels from the root on make of importance.
    role: 0 in a side branch, 1 in an article or main element; main: the outermost such element."""

    __slots__ = ("tag", "label", "above", "side", "weight", "role", "main", "key", "children", "content", "size", "core")

    def __init__(self, tag: str, words: list[str], above: Node | None):
        self.tag = tag
        self.label = ".".join([tag, *sorted(words)])
        self.above = above
        named = tag not in OWN_NAME
        self.side = named and bool(SIDE_WORDS.intersection(words))
        self.weight = SIDE_WEIGHT if named and SIDE_WORDS & {w for x in words for w in re.split(r"[-_]", x)} else 1.0
        self.role, self.main = None, None
        self.key = _number(self.label, 0 if above is None else above.key)
        self.children: list[str] = []
        self.content: list[str] = []
        self.size = 0  # characters of text in the branch
        self.core = tag in ("h1", "main")  # whether the branch has a main heading or main element

    def decide(self, total: int) -> None:
        """From the node above and the whole page: role, main and weight."""
        up = self.above
        wraps = self.core and 2 * self.size > total
        side = self.tag in SIDE_TAGS and not (wraps and self.tag == "form") or self.side and not wraps
        if self.tag in UNSEEN or side or up is not None and up.role == 0:
            self.role = 0
        elif up is not None and up.role == 1:
            self.role, self.main = 1, up.main
        elif self.tag in MAIN_TAGS:
            self.role, self.main = 1, self
        if wraps:
            self.weight = 1.0
        self.weight = min(self.weight, 1.0 if up is None else up.weight)


class Page(HTMLParser):
    """Blocks of text with the nodes they lie in, and every node. Missing and stray end tags are dealt with."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("#page", [], None)
        self.open = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)  # of each kind among the open elements
        self.nodes = [self.root]
        self.blocks: list[list[tuple[Node, str]]] = [[]]
        self.feed(html)
        self.close()
        for node in reversed(self.nodes[1:]):
            if node.tag not in UNSEEN:
                node.above.size += node.size
                node.above.core |= node.core
        for node in self.nodes:
            node.decide(self.root.size)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in BLOCKS:
            if tag in ENDS:
                self._end(*ENDS[tag])
            else:
                self._end(frozenset(["p"]), frozenset("td th li button table".split()))
            self._cut()
        if tag == "br":
            self.handle_data("\n")
            return
        node = Node(tag, (a.get("class", "") + " " + a.get("id", "") + " " + a.get("role", "")).lower().split(), self.open[-1])
        up = self.open[-1]
        if not up.children or up.children[-1] != node.label:
            up.children.append(node.label)
        self.nodes.append(node)
        if tag == "a":
            node.content.append("href " + a.get("href", ""))
        elif tag == "img":
            node.content.append("src " + a.get("src", ""))
        if tag not in VOID:
            self.places[tag].append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash does not end an element that is not void

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._cut()
        self._end(frozenset([tag]), frozenset())

    def handle_data(self, data):
        self.blocks[-1].append((self.open[-1], data))
        if data.strip():
            self.open[-1].content.append(" ".join(data.split()))
            self.open[-1].size += len(self.open[-1].content[-1])

    def _end(self, kinds: frozenset, walls: frozenset) -> None:
        """End the innermost open element of `kinds` unless one of `walls` lies in it; where paragraphs end along with
        others, all such."""
        again = True
        while again:
            last, wall = (max((self.places[k][-1] for k in x if self.places.get(k)), default=0) for x in (kinds, walls))
            if last <= wall:
                return
            for node in reversed(self.open[last:]):
                self.places[node.tag].pop()
            del self.open[last:]
            again = "p" in kinds and len(kinds) > 1

    def _cut(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])

    def text(self, noise: frozenset[int]) -> str:
        """Blocks that stay, by two line ends. An article or main element stays, with all in it where it is noise itself."""
        noisy: dict[Node, bool] = {}
        for node in self.nodes:  # parents come first
            noisy[node] = node.main is not node and (noisy.get(node.above, False) or node.key in noise)

        def stays(node: Node) -> bool:
            return node.role != 0 and (not noisy[node] or node.main is not None and node.main.key in noise)

        lines = (" ".join("".join(t for n, t in b if stays(n)).split()) for b in self.blocks)
        return "\n\n".join(x for x in lines if x)


def _number(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed % (1 << 64)) - (1 << 63)


def _features(host: str, html: str, reach: int) -> Iterator[tuple]:
    """Child sequences and content of a page's nodes outside side branches, counted, with the nearest `reach` ancestors."""
    page, counts, weights, above = _number(html), Counter(), {}, {}
    for n in Page(html).nodes:
        if n.role != 0:
            weights[n.key] = max(weights.get(n.key, 0.0), n.weight * (MAIN_WEIGHT if n.role == 1 else 1.0))
            counts[n.key, "look", _number(" ".join(n.children))] += 1
            counts.update((n.key, "text", _number(c)) for c in n.content)
            above[n.key] = n.above
    for (node, kind, feature), c in counts.items():
        up, a = [], above[node]
        while kind == "look" and a is not None and len(up) < reach:
            up.append(a.key)
            a = a.above
        yield host, page, node, kind, feature, c, weights[node], up


def importance(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(host, node, pages, importance) of every branch of the style trees of `pages` (host, html).

    A branch counts its nodes down to `Settings.reach` levels; deeper ones are below the threshold there anyway.
    """
    reach = settings.reach

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches((f for b in rows for h, t in zip(*(c.to_pylist() for c in b.columns)) for f in _features(h, t, reach)), FEATURES)

    rows = pages.select("host", "html").mapInArrow(run, FEATURES_DDL)
    each = rows.groupBy("host", "node", "kind", "feature", "page").agg(  # copies of a page count once
        F.max("n").alias("n"), F.max("weight").alias("weight"), F.max("up").alias("up"))
    by_feature = each.groupBy("host", "node", "kind", "feature").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.count("*").alias("pages"), F.max("weight").alias("weight"),
        F.max("up").alias("up"))
    entropy = F.log("n") - F.col("nlogn") / F.col("n")  # of one feature over pages
    nodes = by_feature.groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == "look", F.col("pages"))).alias("looks"),
        F.sum(F.when(F.col("kind") == "look", F.col("pages") * F.log("pages"))).alias("plogp"),
        F.max("pages").alias("most"), F.max("weight").alias("weight"),
        F.avg(F.when(F.col("kind") == "text", entropy)).alias("text_entropy"), F.max("up").alias("up"))
    m = F.greatest("looks", "most").cast("double")
    sure = m >= settings.min_pages
    look = (F.log("looks") - F.col("plogp") / F.col("looks")) / F.log(m)
    own = F.when(~sure, 1.0).when(F.col("text_entropy").isNull(), look).otherwise(
        F.greatest(look, 1 - F.least(F.lit(1.0), F.col("text_entropy") / F.log(m))))
    scored = nodes.select("host", m.alias("pages"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), own)).alias("own"), "weight",
                          F.posexplode(F.concat(F.array("node"), "up")).alias("d", "node"))
    return scored.groupBy("host", "node").agg(
        F.least(F.lit(1.0), F.max(F.pow(F.lit(LEVEL), "d") * F.col("own") * F.col("weight"))).alias("importance"),
        F.max(F.when(F.col("d") == 0, F.col("pages"))).alias("pages"))


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages` (page_id, url, html).

    Null or empty html has no text; a null or odd url is of one nameless host; repeated rows are rows of their own. No
    rows: no rows. Other columns are ignored.
    """
    known = pages.select("page_id", "url", host_of().alias("host"), text_of("html").alias("html"))
    noise = importance(known, settings).where(F.col("importance") < settings.threshold).where(F.col("pages") >= settings.min_pages)
    by_host = materialize(noise.groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("noise")), "noise")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in rows:
                for page, url, html, noise in zip(*(c.to_pylist() for c in b.columns)):
                    text = Page(html).text(frozenset(noise or ()))
                    yield page, url, text, len(text)

        yield from batches(each(), TEXTS, 1000)

    return known.join(by_host, "host", "left").select("page_id", "url", "html", "noise").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
