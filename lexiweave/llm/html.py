"""Main text of web pages by consensus host paths.

Pages of one host share a template. Each page's containers are scored (text in blocks, few links, what the tag and its classes
say) and the page votes for the path of its best one: tags with classes from the root, with digits and long hex strings
generalised. Votes are added up for each host and path, in Spark, in proportion to how sure pages are; the path with the most is the
host's. Then each page is extracted again with what its host agreed on, or with its own best where it has no such
container. The parser takes any text for HTML: unclosed, crossed and unknown tags included.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored

#: Winning paths up to which they are broadcast (some 100 bytes each), hosts beyond that are joined by a shuffle.
BROADCAST_HOSTS = 200_000
#: Tags of HTML by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption optgroup option select video audio canvas svg math object".split())
CONTAINER = frozenset("article main section div td body blockquote center form".split())
DROPPED = frozenset("script style noscript template iframe noembed noframes nav footer header aside form button select option optgroup textarea input label fieldset svg math canvas video audio object embed head title menu dialog".split())
#: Tags that hold things, whose class or id may say what they are; a paragraph or a heading of such a name is text.
HOLDERS = frozenset("div section aside ul ol dl table tbody tr td nav header footer form figure details center blockquote main p".split()) - {"p", "blockquote", "main"}
#: Words of a class or id that say what is not the article.
BOILERPLATE = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|sidebar|side|widget|footer|header|masthead|comments?|commentlist|disqus|replies|reply|respond|cookies?|consent|notice|alert|popup|modal|overlay|subscribe|newsletter|signup|login|share|sharing|social|related|recommended|pagination|pager|toolbar|tags|copyright|legal|disclaimer|gdpr|paywall|search)(?:$|[-_ ])"
)
#: Of these, words that say it of a paragraph or heading, too.
NEVER = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|breadcrumbs?|cookies?|consent|subscribe|newsletter|popup|modal|gdpr|paywall)(?:$|[-_ ])")
ARTICLE = re.compile(r"(?:^|[-_ ])(?:article|content|post|entry|story|main|body|text|maincontent|articlebody)(?:$|[-_ ])")
#: Names such as has-sidebar tell of a neighbour.
_BESIDE = re.compile(r"(?:^|[-_ ])(?:with|has|no|without)[-_][a-z0-9]+")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z))", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.S)
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"[0-9a-f]{8,}|\d+")
#: Tags that close others of their own kind, and where that ends.
_CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))), "td": (frozenset(("td", "th")), frozenset(("tr", "table"))), "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
    "body": (frozenset(("head",)), frozenset()),
}
_CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "select", "svg", "math", "canvas", "video", "audio", "object"}


def _inside_article(node: Node | None) -> bool:
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    return node is not None


class Node:
    __slots__ = ("tag", "parent", "step", "items", "dropped", "favoured", "text", "link")

    def __init__(self, tag, parent, attributes=""):
        self.tag, self.parent, self.items = tag, parent, []
        self.text = self.link = 0
        names = hidden = ""
        if attributes:
            found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
            classes = entities.unescape(found.get("class", "")).lower().split()
            names = " ".join([*classes, found.get("id", "").lower()])
            hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower())
            self.step = tag + "".join(f".{_NUMBER.sub('#', c)}" for c in sorted(set(classes)))
            role = found.get("role", "").lower()
        else:
            self.step, role = tag, ""
        own = tag in ("article", "main", "body", "html")
        names = _BESIDE.sub(" ", names)
        # an article's own header has its title; its menus and notices are dropped inside
        titled = tag == "header" and _inside_article(parent)
        named = names and (BOILERPLATE if tag in HOLDERS else NEVER).search(names)
        self.dropped = bool(tag in DROPPED and not titled or hidden or not own and not titled and (role in ROLES or named))
        self.favoured = bool(tag in ("article", "main") or role in ("main", "article") or names and ARTICLE.search(names))

    @property
    def path(self) -> str:
        steps, node = [], self
        while node is not None:
            steps.append(node.step)
            node = node.parent
        return ">".join(reversed(steps))


def parse(source: str) -> Node:
    """The tree of a page: items of a node are strings (decoded), nodes, and None for a line break."""
    root = top = Node("#", None)
    at, n = 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            top.items.append(entities.unescape(source[at:lt]) if "&" in source[at:lt] else source[at:lt])
        if lt == n:
            break
        m = _TAG.match(source, lt)
        if m is None or m[2] and m[4] != ">":
            # quotes that never end: the tag goes to the next >
            m = _LOOSE.match(source, lt) or m
        if m is None:
            if source.startswith("</", lt):  # a bogus comment
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                top.items.append("<")
                at = lt + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                top.items.append(None)
                continue
            node = top
            while node is not root and node.tag != tag:
                # inline ends do not close blocks around them
                node = root if tag not in BLOCK and node.tag in BLOCK else node.parent
            if node is not root and tag not in ("body", "html"):
                top = node.parent
            elif tag == "p":
                top.items.append(None)
            continue
        if tag == "br":
            top.items.append(None)
            continue
        closes = _CLOSES.get(tag)
        if closes:
            node = top
            while node is not root and node.tag not in closes[1]:
                if node.tag in closes[0]:
                    top = node.parent
                node = node.parent
        if tag in _CLOSES_P:
            node = top
            while node is not root and (node.tag == "p" or node.tag not in BLOCK):
                if node.tag == "p":
                    top = node.parent
                    break
                node = node.parent
        node = Node(tag, top, m[3] if m[3].strip(" /\n\t") else "")
        top.items.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|$)", re.I).search(source, at)
            stop = end.start() if end else n
            close = source.find(">", stop)
            at = n if not end or close < 0 else close + 1
            continue
        top = node
    return root


def blocks(node: Node) -> list[str]:
    """Text of a node by blocks, in page order, without what is dropped inside it; white space is one space."""
    out, line = [], []

    def flush():
        if line:
            text = _SPACE.sub(" ", "".join(line)).strip()
            if text:
                out.append(text)
            line.clear()

    waiting = [iter(node.items)]
    ends = [False]
    while waiting:
        for item in waiting[-1]:
            if item is None:
                line.append(" ")
            elif isinstance(item, str):
                line.append(item)
            elif not item.dropped:
                block = item.tag in BLOCK
                if block:
                    flush()
                waiting.append(iter(item.items))
                ends.append(block)
                break
        else:
            waiting.pop()
            if ends.pop():
                flush()
    flush()
    return out


def _measure(root: Node) -> list[Node]:
    """Sets how much text and text in links nodes have, those dropped apart, and returns the nodes parents first."""
    order, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        order.append(node)
        waiting += [x for x in reversed(node.items) if isinstance(x, Node) and not x.dropped]
    for node in reversed(order):
        text = sum(len(x.strip()) for x in node.items if isinstance(x, str))
        kids = [x for x in node.items if isinstance(x, Node) and not x.dropped]
        node.text = text + sum(x.text for x in kids)
        node.link = node.text if node.tag == "a" else sum(x.link for x in kids)
    return order


def _score(node: Node) -> float:
    """Text directly in a container's paragraphs, less links, more for what is named an article."""
    near = 0.0
    for x in node.items:
        if isinstance(x, str):
            near += len(x.strip())
        elif x is not None and not x.dropped:
            near += (x.text - 2 * x.link) * (1.0 if x.tag not in CONTAINER else 0.6)
    return near * (3.0 if node.favoured else 1.0) * (0.5 if node.tag in ("body", "html", "#") else 1.0)


def best(root: Node) -> tuple[Node | None, float]:
    """The container with the highest score, the first of equals, and its share of the sum over all."""
    scored = [(s, x) for x in _measure(root) if (x.tag in CONTAINER or x.favoured or x is root) and (s := _score(x)) > 0]
    if not scored:
        return None, 0.0
    top, node = max(scored, key=lambda x: x[0])
    return node, top / sum(s for s, _ in scored)


def find(root: Node, path: str) -> list[Node]:
    """Nodes with a path, none inside another."""
    steps = path.split(">")
    level = [root]
    for step in steps[1:]:
        level = [x for node in level for x in node.items if isinstance(x, Node) and not x.dropped and x.step == step]
    return level


def extract(source: str | None, path: str | None = None) -> str:
    """Main text of a page: blocks joined by an empty line."""
    root = parse(source or "")
    nodes = find(root, path) if path else []
    text = [b for x in nodes for b in blocks(x)]
    if not text:
        node, _ = best(root)
        # an article may lie in several containers alike
        text = [b for x in find(root, node.path) for b in blocks(x)] if node is not None else []
    return "\n\n".join(text)


def vote(source: str | None) -> tuple[str | None, float]:
    node, share = best(parse(source or ""))
    return (None, 0.0) if node is None else (node.path, share)


def host_of(url):
    """Host of a URL in lower case; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """host and the path that its pages agree on; ties go to the path that is first in order."""

    def run(batches):
        for batch in batches:
            got = [vote(x) for x in batch.column(1).to_pylist()]
            # votes are whole numbers, so that their sum does not depend on the order
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([round(1000 * g[1]) for g in got], pa.int64())], names=["host", "path", "share"])

    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, share long").where("path is not null")
    sums = votes.groupBy("host", "path").agg(F.sum("share").alias("votes"))
    top = sums.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))
    return stored(top, "paths")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of page_id, url, html.

    A null html is empty and so is its text; a null url belongs to the host of no name.
    """
    bounded_batches(pages.sparkSession)
    paths = host_paths(pages)
    few = paths.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(F.broadcast(paths) if few else paths, "host", "left").select("page_id", "url", "html", "path")
    kind = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            text = [extract(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
