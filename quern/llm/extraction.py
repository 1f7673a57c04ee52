"""Main text of HTML pages by tree scoring.

Paragraphs pass points for length and commas to their ancestors; a container's
points are discounted by its link density; the best container and those of its
siblings that hold enough are kept. Elements that are no text of an article by
their kind, and those whose whole class, id or role names a menu, an advert,
reader comments and the like, are cut out of the tree first. A name that merely
holds such a word ("share-prices") lowers a container's score and removes nothing.
Every pass over a page takes time in proportion to its length.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_SCOPE = frozenset("table ul ol dl article section div body html blockquote main".split())
_DROPPED = frozenset("nav aside footer button select option menu dialog object embed canvas svg math audio video map head input datalist".split()) | _RAW
_PARAGRAPHS = frozenset("p pre blockquote td dd li h1 h2 h3 h4 h5 h6".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id or role that mark what is not the article.
_BAD = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle banner banners sponsor sponsored promo promotion promoted comment comments commentlist respond disqus replies reply cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup signin login sidebar side menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead popup popover modal overlay share sharing social related recommended recommendations widget widgets toolbar skip search tags hidden contentinfo complementary paywall disclaimer".split())
#: Those of them that name a text beside the article: an <article> of that name is none.
_BESIDE = frozenset("comment comments commentlist respond disqus replies reply cookie cookies consent gdpr notice notices notification alert newsletter related recommended recommendations disclaimer".split())
#: Those of them that name a layout or a state in which an article may lie.
_STATES = frozenset("side modal overlay popup popover widget widgets search tags paywall".split())
#: Words that may follow or come before one of _BAD without changing what is named.
_PARTS = frozenset("area articles bar block body box button buttons column container content count default form frame group header heading icons inner item items label layer left link links list media news outer panel post posts right row section slot stories text title top bottom fixed unit wrap wrapper info warning danger success policy".split())
_BEFORE = _PARTS | frozenset("desktop fixed global google home is js left main mobile page primary privacy reader right secondary site sticky sub the top user wp your".split())
_FRAMES = frozenset("container frame outer wrap wrapper".split())
#: What a head may hold; anything else ends it.
_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
_GOOD = frozenset("article body content entry main post story text hentry articlebody".split())

_MARKUP = r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)(%s)(>|\Z)|<[!?/][^>]*+(?:>|\Z)"""
_TAG = re.compile(_MARKUP % r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+""", re.S)
_TAG_WITHOUT_QUOTES = re.compile(_MARKUP % "[^>]*+", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _names(words: list[str]) -> str:
    """The word of _BAD that the whole name comes down to ("main-menu", "ad-slot"), or "" if it names something else ("share-prices")."""
    end, framed = len(words), False
    while end and words[end - 1] in _PARTS:
        end -= 1
        framed = framed or words[end] in _FRAMES
    if not end or words[end - 1] not in _BAD:
        return ""
    last, before = words[end - 1], words[: end - 1]
    if any(len(w) > 1 and w not in _BAD and w not in _BEFORE and w not in _GOOD for w in before):
        return ""
    if framed and last not in _BESIDE and any(w in _GOOD and w != "main" for w in before):
        return ""  # the frame around a content and its sidebar
    return last


class _Node:
    """An element. `bad`: cut out; `named`: its name says so; `beside`, `state`: as _BESIDE and _STATES; `doubt`: its name holds such a word."""

    __slots__ = ("tag", "parent", "parts", "bad", "gone", "good", "points", "chars", "linked", "links", "named", "beside", "state", "doubt", "within")

    def __init__(self, tag: str, parent: _Node | None, attributes: str = ""):
        self.tag, self.parent, self.parts = tag, parent, []
        self.points, self.chars, self.linked, self.links, self.good = 0.0, 0, 0, 0, False
        self.gone = tag in _DROPPED
        self.named = self.state = tag == "form"
        self.beside = self.doubt = self.within = self.bad = False
        if attributes and not self.gone and tag not in ("html", "body"):
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id", "role", "itemprop"):
                    if name == "id" and tag in _HEADINGS:
                        continue  # made from the heading's text
                    for token in value.split():
                        words = [w.lower() for w in _WORDS.findall(token)]
                        self.good = self.good or not _GOOD.isdisjoint(words)
                        if not _BAD.isdisjoint(words):
                            word = _names(words)
                            self.doubt = self.doubt or not word
                            if word:
                                self.state = word in _STATES and (self.state or not self.named)
                                self.named, self.beside = True, self.beside or word in _BESIDE
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _UNSEEN.search(value):
                    self.gone = True


def _tree(page: str) -> _Node:
    """Start and end tags as browsers read them, as far as blocks are concerned.

    `stack` holds the open elements, `where` their places by name and `scopes` the places beyond which <p>, <li> and
    the like are not closed, so that no tag looks through the open elements.
    """
    root = _Node("html", None)
    stack, where, scopes = [root], defaultdict(list), [0]
    endless: set[str] = set()
    tags, at = _TAG, 0

    def close(to: int) -> None:
        while len(stack) > to:
            tag = stack.pop().tag
            where[tag].pop()
            if scopes[-1] == len(stack):
                scopes.pop()

    def add(text: str) -> None:
        if stack[-1].tag == "head" and text.strip():
            close(len(stack) - 1)
        stack[-1].parts.append(text)

    while m := tags.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        if tags is _TAG and m[2] and not m[4]:  # its quotes leave no end to the tag: from here on quotes mean nothing
            tags, at = _TAG_WITHOUT_QUOTES, m.start()
            continue
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:  # an end tag closes up to the nearest open element of its name
            if where[name] and (name not in ("p", "li") or where[name][-1] > scopes[-1]):
                close(where[name][-1])
            continue
        if stack[-1].tag == "head" and name not in _HEAD:
            close(len(stack) - 1)
        if name in _CLOSES_P:
            if where["p"] and where["p"][-1] > scopes[-1]:
                close(where["p"][-1])
        elif name in _IMPLIED:
            first = [w[k] for w in (where[t] for t in _IMPLIED[name]) if (k := bisect_right(w, scopes[-1])) < len(w)]
            if first:
                close(min(first))
        if name in ("html", "body"):
            continue
        child = _Node(name, stack[-1], m[3])
        stack[-1].parts.append(child)
        if name in _RAW:
            end = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in ("script", "style"):
                at = len(page)
            else:
                endless.add(name)
                child.gone = False
        elif name not in _VOID and not m[3].endswith("/"):
            where[name].append(len(stack))
            if name in _SCOPE:
                scopes.append(len(stack))
            stack.append(child)
    if at < len(page):
        add(page[at:])
    return root


def _ancestors(node: _Node | None) -> set[int]:
    out = set()
    while node is not None:
        out.add(id(node))
        node = node.parent
    return out


def _article(root: _Node) -> _Node | None:
    """The <article> or <main> with the most text that is no link and lies in nothing beside it; the first of equal ones."""
    order, stack = [], [(root, False, False)]
    held: dict[int, int] = {}
    while stack:
        node, beside, linked = stack.pop()
        beside, linked = beside or node.beside, linked or node.tag == "a"
        held[id(node)] = 0 if beside or linked else sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        order.append((node, beside))
        stack.extend((p, beside, linked) for p in reversed(node.parts) if isinstance(p, _Node) and not p.gone)
    for node, _ in reversed(order):
        if node.parent is not None:
            held[id(node.parent)] += held[id(node)]
    return max((n for n, beside in order if n.tag in ("article", "main") and not beside), key=lambda n: held[id(n)], default=None)


def _nodes(root: _Node, spared: set[int]) -> list[_Node]:
    """Kept elements in page order, without points yet; named elements are cut out but for those in `spared`."""
    out, stack = [], [(root, False)]
    while stack:
        node, within = stack.pop()
        node.bad = node.gone or node.tag == "header" and not within or node.named and id(node) not in spared and (node.beside or node.tag not in ("article", "main"))
        if not node.bad:
            node.points, node.chars, node.linked, node.links = 0.0, 0, 0, 0
            node.within = within or node.tag == "article"
            out.append(node)
            within = within or node.tag in ("article", "main")
            stack.extend((p, within) for p in reversed(node.parts) if isinstance(p, _Node))
    return out


def _score(nodes: list[_Node]) -> None:
    for node in reversed(nodes):  # children before parents
        own = own_linked = 0
        for p in node.parts:
            if isinstance(p, str):
                own += len(p.strip())
            elif not p.bad:
                own += p.chars
                own_linked += p.linked
                node.links += p.links
        node.links += node.tag == "a"
        node.chars, node.linked = own, own if node.tag == "a" else own_linked
    for node in nodes:
        direct = node.tag in _PARAGRAPHS or any(isinstance(p, str) and len(p.strip()) > 1 for p in node.parts)
        if not direct or node.tag in _INLINE or not node.chars:
            continue
        stack, commas = [node], 0
        while stack:
            for p in stack.pop().parts:
                if isinstance(p, str):
                    commas += p.count(",") + p.count("，") + p.count("、")
                elif not p.bad and p.tag in _INLINE:
                    stack.append(p)
        points = (1 + commas + min(node.chars / 100, 3)) * (1 - node.linked / node.chars)
        up, share = node.parent, 1.0
        if node.tag not in _PARAGRAPHS:  # text that lies in a container itself
            node.points += points
        for depth in range(1, 6):
            if up is None:
                break
            up.points += points * share
            up, share = up.parent, 1 / (2 * depth)


def _best(root: _Node, spared: set[int]) -> tuple[_Node, float]:
    """The container with the highest value; values stay in the tree's nodes until the next call."""
    nodes = _nodes(root, spared)
    _score(nodes)
    best, most = root, -1.0
    for node in nodes:
        if node.tag in _INLINE or not node.chars:
            continue
        value = (node.points + (25 if node.tag in ("article", "main") else 8 if node.good else 0)) * (1 - node.linked / node.chars) * (0.5 if node.doubt else 1)
        if value > most:
            best, most = node, value
    return best, most


def _container(root: _Node) -> tuple[_Node, float]:
    """The best container, its value. What lies around the largest article stays; what lies in a form or a named layout counts a tenth."""
    spared = _ancestors(_article(root))
    best, most = _best(root, spared)
    states, stack = set(), [root]
    while stack:
        node = stack.pop()
        if node.named and node.state and id(node) not in spared:
            states.add(id(node))
        if not node.gone:
            stack.extend(p for p in node.parts if isinstance(p, _Node))
    if states:
        other, value = _best(root, spared | states)
        around = _ancestors(other)
        if 0.1 * value > max(most, 0) and not around.isdisjoint(states):
            spared |= around & states
        best, most = _best(root, spared)
    return best, most


def _blocks(keep: list[_Node]) -> list[str]:
    """The texts between block boundaries, in page order."""
    out: list[str] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            if block:
                out.append(block)
            text.clear()

    for top in keep:
        flush()
        stack: list = [top]
        while stack:
            item = stack.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                text.append(item)
            elif item.bad:
                if item.tag not in _INLINE:
                    flush()
            elif item.tag == "br":
                text.append(" ")
            elif item is not top and not item.within and item.tag in ("ul", "ol", "div", "table", "section") and item.chars and item.linked > 0.6 * item.chars and item.chars - item.linked < 8 * item.links:
                flush()  # a menu without a name; in an <article> such a list is the author's
            else:
                if item.tag not in _INLINE:
                    flush()
                    stack.append(None)
                stack.extend(reversed(item.parts))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of one page, a block a line; "" for null, empty or textless pages."""
    if not page:
        return ""
    best, most = _container(_tree(page))
    while best.tag in _PARAGRAPHS and best.parent is not None:
        best = best.parent
    keep = [best]
    if best.parent is not None and best.tag not in ("article", "main"):
        floor = max(10.0, 0.2 * most)
        keep = [
            n
            for n in best.parent.parts
            if isinstance(n, _Node) and not n.bad and (n is best or n.chars and (n.points * (1 - n.linked / n.chars) >= floor or n.tag in _PARAGRAPHS and n.linked < 0.25 * n.chars))
        ]
    elif best.tag == "article" and best.parent is not None:  # further articles of the same kind beside it
        floor = max(10.0, 0.2 * most)
        keep = [n for n in best.parent.parts if isinstance(n, _Node) and not n.bad and (n is best or n.tag == "article" and n.points >= floor)]
    return "\n".join(_blocks(keep))


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages`, whole pages, no shuffle.

    Cases: null and empty pages give text "" and 0; null keys and urls are passed on; repeated rows
    give repeated rows; an empty table gives none; further columns are ignored; markup that never
    closes is read to the end of the page; length and depth are unbounded, and time grows with the length alone.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extract, schema)
