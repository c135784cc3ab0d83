"""Main text of web pages by consensus paths of their hosts.

First pass: in each page the containers are scored by the text they hold, links counted against them, and the deepest
container that still holds nearly all of it is the page's choice. Names that hint at menus, adverts or comments count as
evidence only: what they mark is left out as long as the page keeps its text without it. Its path is generalised (tags, classes without
their numbers) and counts, as a hash of the whole of it, as a vote; Spark sums the votes per host. Second pass: each page is read again and the text
is taken from the containers at its host's winning path, or at its own choice where it has no such container.
"""

from __future__ import annotations

import hashlib
import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import bound_batches, materialize, slices, split_join

# Element names by their part in a page.
CONTAINERS = frozenset("html body main article section div header footer nav aside form ul ol dl table tbody thead tfoot tr td th center figure details fieldset head".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre address hr figcaption summary caption option legend".split()) | CONTAINERS
NEVER = frozenset("head nav footer aside form button select dialog menu".split())
RAW = frozenset("script style noscript template iframe svg textarea title object canvas math".split())
# Inline elements whose classes may mark them, and blocks that may hold others.
INLINE = frozenset("span a small ins strong em b i u label font".split())
NESTING = frozenset("li dt dd blockquote address figcaption".split())
# Words in classes, ids and roles that hint at parts beside the article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner comment comments discussion disqus reply replies respond"
    " sidebar menu nav navbar navigation topnav breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription"
    " share sharing social related recommended widget widgets login signup toolbar pagination pager masthead search alert contentinfo complementary dialog".split()
)
#: Share of a container's text that one child must hold to be chosen instead of it.
NEARLY_ALL = 0.7
#: Share of a page's text that must be left without its marked parts, or that articles outside of them must hold.
REST, REST_ARTICLE = 0.2, 0.05
#: Hosts up to which the winning paths are broadcast (a path is a hash of PATH_BYTES bytes, in hex); beyond, they are joined.
BROADCAST_HOSTS, PATH_BYTES = 20_000, 16

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile("[>\"']")
_NEXT_BLOCK = re.compile("</?(?:" + "|".join(sorted(BLOCKS)) + r")[\s>/]", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_EACH = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    """A container: its tag and generalised step, whether it stands beside the article or is marked so, and what it holds in order."""

    __slots__ = ("beside", "items", "links", "marked", "parent", "path", "step", "tag", "text")

    def __init__(self, tag: str, step: str, beside: bool, parent: Node | None, marked: bool = False):
        self.tag, self.step, self.beside, self.parent, self.marked = tag, step, beside, parent, marked
        #: running hash of all steps from the root to here
        self.path = hashlib.blake2b((parent.path if parent else b"") + step.encode("utf-8", "surrogatepass"), digest_size=PATH_BYTES).digest()
        self.items: list[Node | str | None] = []  # a None ends a block
        self.text = self.links = 0


def _hidden(attributes: str) -> bool:
    """Whether attributes hide the element: hidden as a name of its own, aria-hidden or a style without display."""
    for m in _EACH.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
        if (name == "hidden" and value != "false") or (name == "aria-hidden" and value == "true") or (name == "style" and _NO_DISPLAY.search(value)):
            return True
    return False


def _step(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The generalised step, whether the element is hidden, and whether names in it mark a part beside the article."""
    names: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        names.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    said = names.get("class") or names.get("id") or ""
    step = ".".join([tag, *sorted(re.sub(r"\d+", "#", c.lower()) for c in said.split())])
    # an article is one whatever its classes say of comments, ads or sharing
    parts = {p.lower() for n in names.values() for p in _PART.findall(n)} if tag != "article" else set()
    return step, bool(attributes and _hidden(attributes)), bool(parts & BESIDE)


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """The page's texts and tags in order, as (tag, attributes, text): a text has no tag, a closing tag begins with /.

    Comments, declarations and raw elements (scripts, drawings and the like) are left out. A raw element that never
    ends, ends at the next block. A quote in a tag that has no partner is a character as any other; if the tags of a
    page then still do not end, quotes count for nothing from there on. Every part of a page is looked at a bounded
    number of times: what is not found once, is not looked for again.
    """
    at, size, quotes, last = 0, len(page), True, page.rfind(">")
    missing: set[str] = set()
    text: list[str] = []

    def end_of(at: int) -> int:
        """Where the > of the tag at ``at`` is, outside quotes; -1 without one."""
        while (m := _STOP.search(page, at)) is not None:
            if m[0] == ">":
                return m.start()
            at = m.end()
            if quotes and m[0] not in missing:
                close = page.find(m[0], at)
                if close < 0:
                    missing.add(m[0])
                else:
                    at = close + 1
        return -1

    while at < size:
        low = page.find("<", at)
        if low < 0 or low > last:
            text.append(page[at:])
            break
        if low > at:
            text.append(page[at:low])
        if page.startswith("<!--", low):
            close = page.find("-->", low + 4)
            at = size if close < 0 else close + 3
            continue
        if page[low + 1 : low + 2] in ("!", "?"):
            at = page.find(">", low) + 1
            continue
        name = _NAME.match(page, low + 1)
        if name is None:
            text.append("<")
            at = low + 1
            continue
        high = end_of(name.end())
        if high < 0:
            quotes = False
            high = end_of(name.end())
        tag, attributes, at = name[0].lower(), page[name.end() : high], high + 1
        if tag in RAW:
            if not attributes.endswith("/"):
                m = None if tag in missing else _CLOSE[tag].search(page, at)
                if m is None:
                    missing.add(tag)
                    m = _NEXT_BLOCK.search(page, at)
                    at = m.start() if m else size
                else:
                    at = m.end()
            continue
        if text:
            yield "", "", "".join(text)
            text.clear()
        yield tag, attributes, ""
    if text:
        yield "", "", "".join(text)


def parse(page: str) -> Node:
    """The tree of containers, and of other elements that are hidden or marked; anything else is text, a block's end or markup to drop.

    A hidden or marked block or inline element is a node as well. It ends with its end tag, and at the latest with the
    next block (inline elements and paragraphs) or its container.
    """
    root = node = Node("", "", False, None)
    links, open_tags = 0, Counter()

    def leave(to: str) -> None:
        """Close the innermost open element of a name, and all within it."""
        nonlocal node
        while open_tags[to]:
            found = node.tag == to
            open_tags[node.tag] -= 1
            inline = node.tag in INLINE
            node = node.parent
            if not inline:
                node.items.append(None)
            if found:
                break

    for tag, attributes, text in scan(page):
        if not tag:
            node.items.append(text)
            size = len(text.strip())
            node.text += size
            node.links += size * (links > 0)
            continue
        closing, tag = tag[0] == "/", tag.lstrip("/")
        if tag == "br":
            node.items.append(" ")
        elif tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            if closing:
                if node.tag == tag:
                    leave(tag)
            elif not attributes.endswith("/"):
                step, hidden, marked = _step(tag, attributes) if attributes else (tag, False, False)
                if hidden or marked or node.tag == tag:  # an element within one of its name has an end of its own
                    child = Node(tag, step, hidden, node, marked)
                    open_tags[tag] += 1
                    node.items.append(child)
                    node = child
        elif tag in BLOCKS:
            while node.tag in INLINE or (node.tag in BLOCKS and node.tag not in CONTAINERS and node.tag not in NESTING and not (closing and node.tag == tag)):
                leave(node.tag)
            node.items.append(None)
            if tag not in CONTAINERS:
                if closing:
                    if node.tag == tag:
                        leave(tag)
                else:
                    if node.tag == tag:  # the next li ends the one before
                        leave(tag)
                    step, hidden, marked = _step(tag, attributes) if attributes else (tag, False, False)
                    if (hidden or marked) and not attributes.endswith("/"):
                        child = Node(tag, step, hidden, node, marked)
                        open_tags[tag] += 1
                        node.items.append(child)
                        node = child
                continue
            if closing:
                leave(tag)
            elif not attributes.endswith("/"):
                if tag == "body":
                    while node.parent is not None and node.tag != "html":
                        open_tags[node.tag] -= 1
                        node = node.parent
                step, hidden, marked = _step(tag, attributes)
                child = Node(tag, step, tag in NEVER or (hidden and tag not in ("html", "body", "main")), node, marked and tag not in ("html", "body", "main"))
                open_tags[tag] += 1
                node.items.append(child)
                node, links = child, 0
    return root


def judge_marks(root: Node) -> None:
    """Decide which marked parts stand beside the article: all of them, as long as the rest of the page still has its text.

    Names are evidence only: a wrapper called content-sidebar-wrap holds the article and its sidebar. If without the
    marked parts a page keeps neither REST of its text nor an article or main element with REST_ARTICLE of it, the
    marked parts of one name that hold the most text are taken for wrappers, and those within them are looked at.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.items if isinstance(x, Node) and not x.beside]
    plain: dict[int, float] = {}
    articles: dict[int, float] = {}
    for node in reversed(order):
        inner = [x for x in node.items if isinstance(x, Node) and not x.beside]
        plain[id(node)] = max(0.0, node.text - 2.0 * node.links) + sum(plain[id(x)] for x in inner)
        articles[id(node)] = plain[id(node)] if node.tag in ("article", "main") else sum(articles[id(x)] for x in inner)
    rest, rest_articles = plain[id(root)], articles[id(root)]
    groups: dict[str, list[tuple[Node, float, float, bool]]] = {}
    heap: list[tuple[float, str]] = []

    def look_below(tops: list[tuple[Node, bool]]) -> None:
        """Take the outermost marked parts below nodes for parts beside the article."""
        nonlocal rest, rest_articles
        new: set[str] = set()
        stack = [(x, inside) for top, inside in tops for x in top.items if isinstance(x, Node)]
        while stack:
            node, inside = stack.pop()
            if node.beside:
                continue
            if node.marked:
                size, lost = plain[id(node)], plain[id(node)] if inside else articles[id(node)]
                groups.setdefault(node.step, []).append((node, size, lost, inside))
                rest, rest_articles = rest - size, rest_articles - lost
                new.add(node.step)
            else:
                inside = inside or node.tag in ("article", "main")
                stack += [(x, inside) for x in node.items if isinstance(x, Node)]
        for step in new:
            heapq.heappush(heap, (-sum(size for _, size, *_ in groups[step]), step))

    look_below([(root, False)])
    whole = plain[id(root)]
    while heap and rest < REST * whole and rest_articles < REST_ARTICLE * whole:
        _, step = heapq.heappop(heap)
        wrappers = groups.pop(step, [])
        for node, size, lost, _ in wrappers:
            rest, rest_articles = rest + size, rest_articles + lost
            node.marked = False
        look_below([(node, inside or node.tag in ("article", "main")) for node, _, _, inside in wrappers])
    for held in groups.values():
        for node, *_ in held:
            node.beside = True


def main_tree(page: str) -> tuple[Node, dict[int, float]]:
    """The tree of a page and its containers' weights. Where all text stands in forms, forms are containers as others."""
    root = parse(page)
    judge_marks(root)
    score = _weigh(root)
    if not score[id(root)]:
        stack = [root]
        while stack:
            node = stack.pop()
            if node.tag == "form":
                node.beside = False
            stack += [x for x in node.items if isinstance(x, Node)]
        score = _weigh(root)
    return root, score


def _weigh(root: Node) -> dict[int, float]:
    """Per container: text outside links less text in links, with all below it that does not stand beside the article."""
    score: dict[int, float] = {}
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, done = stack.pop()
        if not done:
            stack.append((node, True))
            stack += [(x, False) for x in node.items if isinstance(x, Node)]
        else:
            below = sum(score[id(x)] for x in node.items if isinstance(x, Node))
            score[id(node)] = 0.0 if node.beside else max(0.0, node.text - 2.0 * node.links) + below
    return score


def choose(root: Node, score: dict[int, float]) -> Node:
    """The deepest container that holds nearly all text; an article or main element among the candidates ends the search."""
    node = root
    while True:
        inner = [x for x in node.items if isinstance(x, Node) and not x.beside]
        best = max(inner, key=lambda x: score[id(x)], default=None)
        if best is None or score[id(best)] < NEARLY_ALL * score[id(node)] or not score[id(best)] or (node.tag in ("article", "main") and best.tag not in ("article", "section", "div")):
            return node
        node = best
        if node.tag == "article":
            return node


def _find(root: Node, path: str) -> list[Node]:
    """The outermost containers at a generalised path, given as its hash in hex."""
    found, stack, wanted = [], [root], bytes.fromhex(path)
    while stack:
        node = stack.pop()
        if node.parent is not None and node.path == wanted:
            found.append(node)
        else:
            stack += [x for x in reversed(node.items) if isinstance(x, Node) and not x.beside]
    return found


def blocks_of(node: Node) -> list[str]:
    """The text blocks below a container, in order, without the parts beside the article."""
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(text)
            held.clear()

    stack: list[tuple[Iterator, bool]] = [(iter(node.items), False)]
    while stack:
        items, inline = stack[-1]
        for x in items:
            if x is None:
                end()
            elif isinstance(x, str):
                held.append(x)
            else:
                within = x.tag in INLINE
                if not within:
                    end()
                if not (x.beside or (x.tag == "header" and node.tag != "article")):
                    stack.append((iter(x.items), within))
                    break
        else:
            if not inline:
                end()
            stack.pop()
    return out


def extract(page: str, path: str | None) -> str:
    root, score = main_tree(page)
    found = _find(root, path) if path else []
    parts = [b for n in found for b in blocks_of(n)]
    if not parts:
        parts = blocks_of(choose(root, score))
    return "\n".join(parts)


def host_paths(pages: DataFrame, host: str, page: str) -> DataFrame:
    """(host, path): the hash of the path with the most votes of each host, then the most text, then the last in order."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (part for batch in batches for part in slices(batch, 1)):
            votes: Counter = Counter()
            chars: Counter = Counter()
            for h, s in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                node = choose(*main_tree(s or ""))
                if node.parent is not None:
                    votes[h, node.path.hex()] += 1
                    chars[h, node.path.hex()] += node.text
            keys = list(votes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([votes[k] for k in keys], pa.int64()), pa.array([chars[k] for k in keys], pa.int64())], ["host", "path", "votes", "chars"]
            )

    counted = pages.select(F.col(host).alias("host"), F.col(page).alias("page")).mapInArrow(vote, "host string, path string, votes bigint, chars bigint")
    summed = counted.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("chars").alias("chars"))
    return summed.groupBy("host").agg(F.max(F.struct("votes", "chars", "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row of ``pages``: key, url, text, n_chars.

    Blocks are joined by a line feed, white space in a block becomes one space, character references are decoded. A
    null or empty page gives the empty text; a null or broken url counts to one host without a name; a null key stays
    null; repeated rows repeat (and vote each); other columns are left aside; an empty table gives an empty result.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(key).cast("bigint").alias("k"), F.col(url).cast("string").alias("u"), F.col(page).cast("string").alias("page"), F.coalesce(F.lower(F.try_parse_url(F.col(url).cast("string"), F.lit("HOST"))), F.lit("")).alias("host"))
    paths = materialize(host_paths(rows, "host", "page"))
    if paths.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(paths), "host", "left")
    else:
        joined = split_join(rows, paths, "host", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in slices(batch, 2):
                texts = [extract(p or "", path) for p, path in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["k", "u", "text", "n_chars"])

    out = joined.select("k", "u", "page", "path").mapInArrow(read, "k bigint, u string, text string, n_chars bigint")
    return out.select(F.col("k").alias(key), F.col("u").alias(url), "text", "n_chars")
