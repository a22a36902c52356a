"""Main text of web pages by a tree-structured graphical model.

A page becomes the tree of its block elements. Every node is content or not:
its own features (names in tag, class, id and role; kind of tag; words; share
of words in links) give it a potential, and every parent and child have a
joint potential. One sum-product pass up the tree and one down give the exact
marginal of each node; text blocks of nodes with a marginal of ``LEVEL`` or
more are the main text, in page order.

Names such as "comments" or "footer" are strong evidence, the other features
weak one (the potentials of both are learned and bounded). An element that
bears names of both kinds is judged by its other features; a name is not
believed where the element holds most of the page and its marked content.

Potentials are counted on labelled pages: pages that mark their main text
themselves with one <article> or <main> (a sample of ``MAX_LABELLED`` such
pages, those with the smallest hash of their id). A node is labelled content
if at least half of its words stand there. For half of these pages the names
are hidden from the counts, so that the other features learn to decide alone.
Counts start from a small stated prior, which decides where no page is
labelled.

Inline tags don't part blocks, nor do scripts, pictures, formulas, media with
their fallback text and form controls; <br> is white space. Scripts, styles,
text fields, comments and the head have no text, and a form has none unless it
holds the marked content or most of the page's words. Character references are decoded, white
space becomes one space, blocks are joined by a newline. Nothing is capped.

Nulls, ties and edge cases: null or empty html, and pages without content,
give an empty text; repeated rows are extracted as often as given; broken
markup is read as far as it goes; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that a fit reads at most; the marginal of main text.
MAX_LABELLED, LEVEL = 2_000, 0.5

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Elements without text; all but the head run to the end of the page if nothing ends them.
_RAW, _NO_TEXT = frozenset("script style textarea title".split()), frozenset(["head"])
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img map
 button label output meter progress object audio video canvas template noscript iframe picture svg g defs desc symbol use path rect circle ellipse line polyline polygon text tspan textpath
 lineargradient radialgradient stop clippath mask pattern marker filter foreignobject animate math semantics annotation annotation-xml maction menclose merror mfenced mfrac mglyph mi
 mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover""".split())
#: Inline tags that part words.
_SPACED = frozenset("br select option optgroup datalist".split())
#: A start tag on the left ends an open element on the right.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPE = frozenset("ul ol dl table body html article section div main aside nav".split())

_BOILER = frozenset("""ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner nav navbar navigation menu
 breadcrumb breadcrumbs header masthead footer foot sidebar aside complementary widget related recommended share sharing social comment
 comments discussion reply replies respond notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup
 login search toolbar pagination pager tags copyright legal disclaimer skip contentinfo""".split())
_CONTENT = frozenset("article main content post entry story articlebody body-text text prose page-content".split())
_WORDS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("parent", "tag", "named", "words", "linked", "pieces", "hidden", "children")

    def __init__(self, parent: int, tag: str, named: str):
        self.parent, self.tag, self.named = parent, tag, named
        self.words = self.linked = 0


def _named(tag: str, attributes: str, inside_content: bool) -> str:
    """"boiler", "content" or "" by the names an element bears; "" too if it
    bears both kinds."""
    names = [tag]
    for name, value in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        low = name.lower()
        if low in ("class", "id", "role", "itemprop"):
            names += _WORDS.findall(re.sub("([a-z])([A-Z])", r"\1 \2", value).lower())
        elif low == "hidden" or low == "aria-hidden" and "true" in value or low == "style" and re.search(r"display\s*:\s*none", value):
            return "boiler"
    if tag == "header" and inside_content:
        names = names[1:]
    boiler, content = any(n in _BOILER for n in names), any(n in _CONTENT for n in names)
    return "" if boiler == content else "boiler" if boiler else "content"


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements (parents before children; number 0 is the page) and the
    text blocks (element, text) in page order."""
    nodes, stack = [Node(-1, "", "")], [0]
    blocks: list[tuple[int, str]] = []
    text: list[str] = []
    in_link = False
    content_depth = 0
    at = 0

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                blocks.append((stack[-1], joined))
            text.clear()

    def add(raw: str) -> None:
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            text.append(raw)
            n = len(raw.split())
            node = nodes[stack[-1]]
            node.words += n
            if in_link:
                node.linked += n

    def pop() -> None:
        nonlocal content_depth
        content_depth -= nodes[stack.pop()].named == "content"

    while True:
        m = _MARKUP.search(html, at)
        add(html[at:m.start()] if m else html[at:])
        if not m:
            break
        at = m.end()
        if m.group(2) is None:
            continue
        tag, closing = m.group(2).lower(), m.group(1)
        if tag in _SPACED:
            text.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in _INLINE:
            continue
        elif closing:
            if tag == "p" or any(nodes[i].tag == tag for i in stack):
                flush()
                while any(nodes[i].tag == tag for i in stack[1:]):
                    last = nodes[stack[-1]].tag == tag
                    pop()
                    if last:
                        break
        elif tag == "input":
            continue
        elif tag in _RAW or tag in _NO_TEXT:
            if not m.group(3).endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html) if tag in _RAW else at
        else:
            flush()
            if nodes[stack[-1]].tag == "p":  # a block ends an open paragraph
                pop()
            for i in range(len(stack) - 1, 0, -1) if tag in _CLOSES else ():
                open_tag = nodes[stack[i]].tag
                if open_tag in _CLOSES[tag]:
                    while len(stack) > i:
                        pop()
                elif open_tag in _SCOPE:
                    break
            if tag not in _VOID:
                named = _named(tag, m.group(3), content_depth > 0)
                nodes.append(Node(stack[-1], tag, named))
                stack.append(len(nodes) - 1)
                content_depth += named == "content"
                in_link = False
    flush()
    return nodes, _without_forms(nodes, blocks)


def _without_forms(nodes: list[Node], blocks: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The blocks outside of forms; a form goes with its words unless it holds
    the page's marked content or most of its words."""
    if not any(n.tag == "form" for n in nodes):
        return blocks
    words, _ = _totals(nodes)
    holds = [words[i] > 0 and (n.named == "content" or n.tag in ("article", "main")) for i, n in enumerate(nodes)]
    for i in range(len(nodes) - 1, 0, -1):
        holds[nodes[i].parent] |= holds[i]
    gone = [False] * len(nodes)
    for i, n in enumerate(nodes):
        gone[i] = i > 0 and gone[n.parent] or n.tag == "form" and not holds[i] and 2 * words[i] < words[0]
        if gone[i]:
            n.words = n.linked = 0
    return [(i, t) for i, t in blocks if not gone[i]]


def _totals(nodes: list[Node]) -> tuple[list[int], list[int]]:
    """Words and linked words of each node with all below it."""
    words, linked = [n.words for n in nodes], [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        words[nodes[i].parent] += words[i]
        linked[nodes[i].parent] += linked[i]
    return words, linked


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LISTS = frozenset("ul ol li dl dt dd table tr td th tbody thead".split())


def place(node: Node) -> str:
    """Which joint potential a node has with its children."""
    return "root" if node.tag in ("", "html", "body") else node.named or "other"


def _disbelieve(nodes: list[Node], words: list[int]) -> None:
    """Drop the names of elements that hold most of the page's words and an
    element named content."""
    holds = [n.named == "content" for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        holds[nodes[i].parent] |= holds[i]
    for i, n in enumerate(nodes):
        if n.named == "boiler" and (n.tag in ("html", "body") or holds[i] and 5 * words[i] >= 3 * words[0] and n.tag not in ("nav", "footer", "aside")):
            n.named = ""


def features(node: Node, words: int, linked: int, names: bool = True) -> tuple[str, ...]:
    kind = "p" if node.tag in ("p", "blockquote", "pre") else "h" if node.tag in _HEADINGS else "list" if node.tag in _LISTS else "box"
    size = "w0" if words == 0 else "w8" if words < 8 else "w25" if words < 25 else "w80" if words < 80 else "w+"
    share = 0 if words == 0 or linked == 0 else min(3, 1 + 3 * linked // words)
    out = (f"kind:{kind}", f"size:{kind[0]}{size}", f"links:{share}")
    return (*out, f"named:{node.named}") if names and node.named else out


#: Counts that every feature starts from: (not content, content).
PRIOR = {"named:boiler": (60.0, 0.5), "named:content": (1.0, 20.0), "links:0": (2.0, 4.0), "links:2": (6.0, 2.0), "links:3": (20.0, 1.0), "kind:p": (1.0, 8.0), "kind:h": (1.0, 5.0)}
#: (parent, child) counts to start from, by the parent's place and by label.
PRIOR_PAIRS = {
    "root": ((30.0, 1.0), (15.0, 15.0)), "other": ((30.0, 1.0), (2.0, 30.0)),
    "content": ((30.0, 1.0), (2.0, 60.0)), "boiler": ((300.0, 0.1), (15.0, 0.02)),
}
#: Bounds of the potentials of a name and of any other feature.
NAME_BOUND, BOUND = {"named:boiler": 7.2, "named:content": 3.6}, 1.2


def _label_counts(html: str, hide_names: bool) -> Counter:
    """Feature and pair counts of one page that marks its main text."""
    nodes, _ = parse(html)
    marked = [i for i, n in enumerate(nodes) if n.tag in ("article", "main")]
    out: Counter = Counter()
    if len(marked) != 1:
        return out
    words, linked = _totals(nodes)
    if not words[marked[0]]:
        return out
    _disbelieve(nodes, words)
    inside = [False] * len(nodes)
    label = [0] * len(nodes)
    good = [0] * len(nodes)
    for i, n in enumerate(nodes):
        inside[i] = i == marked[0] or i > 0 and inside[n.parent] and n.named != "boiler"
        good[i] = n.words if inside[i] else 0
    for i in range(len(nodes) - 1, 0, -1):
        good[nodes[i].parent] += good[i]
    for i, n in enumerate(nodes):
        if not words[i]:
            continue
        label[i] = int(2 * good[i] >= words[i])
        out["label", label[i], 0] += 1
        for f in features(n, words[i], linked[i], not hide_names):
            out[f, label[i], 0] += 1
        if i and not hide_names:
            out[f"pair:{place(nodes[n.parent])}", label[n.parent], label[i]] += 1
    return out


class Model:
    """Log potentials: ``unary`` by feature (content minus not content),
    ``pair`` by the parent's place: [parent][child] label."""

    def __init__(self, counts: dict[tuple[str, int, int], float]):
        total = [20.0 + counts.get(("label", y, 0), 0) for y in (0, 1)]
        names = {f for f, _, _ in counts if f != "label" and not f.startswith("pair:")} | set(PRIOR)
        self.unary = {}
        for f in names:
            prior = PRIOR.get(f, (1.0, 1.0))
            ratio = math.log((prior[1] + counts.get((f, 1, 0), 0)) / total[1]) - math.log((prior[0] + counts.get((f, 0, 0), 0)) / total[0])
            bound = NAME_BOUND.get(f, BOUND)
            self.unary[f] = min(max(ratio, -bound), bound)
        self.pair = {}
        for where, prior in PRIOR_PAIRS.items():
            rows = [[prior[a][b] + counts.get((f"pair:{where}", a, b), 0) for b in (0, 1)] for a in (0, 1)]
            self.pair[where] = [[x / sum(row) for x in row] for row in rows]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Each node's probability of content, by one pass up and one down.
        Messages are log ratios (content to not content)."""
        words, linked = _totals(nodes)
        _disbelieve(nodes, words)
        own = [sum(self.unary.get(f, 0.0) for f in features(n, words[i], linked[i])) if words[i] else 0.0 for i, n in enumerate(nodes)]
        pairs = [self.pair[place(n)] for n in nodes]

        def message(x: float, a: float, b: float, c: float, d: float) -> float:
            r = math.exp(min(max(x, -40.0), 40.0))
            return math.log((c + d * r) / (a + b * r))

        belief, sent = list(own), [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):  # children come after parents
            if words[i]:
                (p00, p01), (p10, p11) = pairs[nodes[i].parent]
                sent[i] = message(belief[i], p00, p01, p10, p11)
                belief[nodes[i].parent] += sent[i]
        for i in range(1, len(nodes)):
            if words[i]:
                (p00, p01), (p10, p11) = pairs[nodes[i].parent]
                belief[i] += message(belief[nodes[i].parent] - sent[i], p00, p10, p01, p11)
        return [1 / (1 + math.exp(-min(max(b, -40.0), 40.0))) for b in belief]

    def text(self, html: str, level: float = LEVEL) -> str:
        nodes, blocks = parse(html)
        if not blocks:
            return ""
        keep = self.marginals(nodes)
        return "\n".join(t for i, t in blocks if keep[i] >= level)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_labelled: int = MAX_LABELLED) -> Model:
    rows = pages.where(F.col(id_col).isNotNull() & F.rlike(html_col, F.lit("(?i)<(article|main)[\\s>]"))).select(F.col(id_col).alias("_id"))
    sample = rows.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled).distinct()
    chosen = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("html")).join(F.broadcast(sample), "_id").select("html", (F.pmod(F.xxhash64("_id"), F.lit(2)) == 0).alias("hide"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for html, hide in zip(*(c.to_pylist() for c in batch.columns)):
                total.update(_label_counts(html or "", hide))
        name, a, b = zip(*total) if total else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(list(total.values()), pa.int64())], names=["f", "a", "b", "n"])

    got = chosen.mapInArrow(count, "f string, a int, b int, n bigint").groupBy("f", "a", "b").agg(F.sum("n").alias("n")).collect()
    return Model({(r["f"], r["a"], r["b"]): r["n"] for r in got})


def main_text(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every row."""
    kind = pages.schema[id_col].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(extract, f"page_id {kind}, url string, text string")
