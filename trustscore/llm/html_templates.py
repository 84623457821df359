"""Main text of web pages by site template removal.

Every container element is named by a hash of its host and its whole subtree: tags, roles, classes and text. Ids,
links and all other attributes are left out, and so are the digits in class names, because they differ from page to
page. Spark counts on how many pages with different main texts each name stands; a subtree that recurs on ``share`` of
the different pages of its host, ``min_pages`` at least, is a template of the site and is deleted from every page of
that host. What recurs too rarely to be counted is recognised by what it is: menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and comments by tag, role, class or id. What is left of the article (of
``main`` or the body where a page has none) is cut into blocks and its references are decoded.

Running text of an article (paragraphs, headings, lists, tables) is never a template, however often it is copied, nor
is a subtree that holds half of its page's main text. No element is deleted for its class or id that holds most of the
running text of its article, or of its page where it is in none.

Defined cases: null or empty html has empty text; a null url is a host of its own; markup that is never closed ends
with its parent; repeated rows are pages each, and rows that share a page_id (or have none) share nothing else; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustscore.llm.words import list_array
from trustscore.session import materialized

_TAG = re.compile(r"<!--.*?-->|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)", re.S)
# Up to the next ">" or over the next "=" and its value; a quote that is never closed opens no value.
_STEP = re.compile(r"[^>=]*+(?:(=)\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+")
_ATTRIBUTE = re.compile(r"([^\s/=]+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|(\S*+)))?+")
_DIGITS = re.compile(r"[0-9]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
FLOW = frozenset(
    "p h1 h2 h3 h4 h5 h6 pre blockquote ul ol li dl dt dd table caption thead tbody tfoot tr td th figure figcaption hr "
    "address".split()
)
CLOSES_P = FLOW | frozenset("article aside details div fieldset footer form header main nav section".split())
ENDED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
SCOPE = frozenset("ul ol dl table article main body html section div td th".split())
DROPPED_TAGS = frozenset(
    "head script style noscript template nav header footer aside form button select textarea iframe svg canvas object "
    "video audio dialog menu title noframes xmp".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar cookie cookies "
    "consent notice notices newsletter subscribe popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs "
    "header footer masthead comment comments disqus replies share sharing social related recommended widget login "
    "signup toolbar pagination pager".split()
)
KEPT_TAGS = frozenset("html body main article".split())


@dataclass
class Node:
    tag: str
    start: int
    parent: "Node | None" = None
    names: str = ""
    classes: str = ""
    role: str = ""
    hidden: bool = False
    opened: int = 0  # where its content begins
    end: int = -1
    parts: list = field(default_factory=list)  # text pieces and child nodes


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where the ">" of a tag is whose attributes begin at ``at``: the first outside quoted values of any length.

    Where quoted values hold all that follow, it is the first of all. ``dead`` keeps the equals signs from which
    no ">" was found, so that all tags of a page are walked in linear time.
    """
    here, passed = at, []
    while True:
        step = _STEP.match(page, here)
        here, sign = step.end(), step.start(1)
        if sign < 0:
            if here < len(page):
                return here
            break
        if sign in dead:
            break
        passed.append(sign)
    dead.update(passed)
    return page.find(">", at)


def parse(page: str) -> Node:
    """A forgiving element tree; every node knows its range in the page."""
    root = Node("#root", 0)
    here, at = root, 0

    def close(node: Node, until: int) -> Node:
        """Close everything up to ``node``."""
        nonlocal here
        while True:
            here.end = until
            done, here = here, here.parent
            if done is node:
                return here

    position, last = 0, page.rfind(">") + 1
    dead: set[int] = set()
    while match := _TAG.search(page, position, last):
        if match.start() > at:
            here.parts.append(page[at : match.start()])
        position = at = match.end()
        tag = match.group(2)
        if tag is None:
            continue
        tag, stop = tag.lower(), _tag_end(page, match.end(), dead)
        attributes = page[match.end() : stop]
        position = at = stop + 1
        if match.group(1):
            node = here
            while node is not root and node.tag != tag:
                if node.tag in ("article", "body", "html") and tag in INLINE:
                    node = root
                    break
                node = node.parent
            if node is not root:
                close(node, at)
            continue
        if tag in CLOSES_P or tag in ENDED_BY:
            enders = ENDED_BY.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            node, found = here, None
            while node is not root:
                if node.tag in enders:
                    found = node
                    if node.tag == "p" or tag != "tr" or node.tag == "tr":
                        break
                elif node.tag in SCOPE:
                    break
                node = node.parent
            if found is not None:
                close(found, match.start())
        node = Node(tag, match.start(), here, opened=at)
        if attributes and not attributes.isspace():
            for name, *values in _ATTRIBUTE.findall(attributes):
                name = name.lower()
                if name == "role":
                    node.role = "".join(values).strip().lower()
                elif name == "hidden" or name == "aria-hidden" and "".join(values).strip().lower() != "false":
                    node.hidden = True
                elif name in ("class", "id"):
                    node.names += " " + "".join(values).lower()
                    if name == "class":
                        node.classes += " " + _DIGITS.sub("", "".join(values).lower())
        here.parts.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in FLOW | KEPT_TAGS | {"div", "section"}:
            node.end = at
        elif tag in RAW:
            stop = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, position)
            node.end = position = at = stop.end() if stop else len(page)
        else:
            here = node
    if at < len(page):
        here.parts.append(page[at:])
    close(root, len(page))
    return root


def nodes(root: Node) -> Iterator[Node]:
    """All nodes in page order."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(part for part in reversed(node.parts) if isinstance(part, Node))


def _never_text(node: Node) -> bool:
    return node.tag in DROPPED_TAGS or node.hidden or node.role in DROPPED_ROLES


def _unwanted_name(node: Node) -> bool:
    return bool(node.names) and node.tag not in KEPT_TAGS and not DROPPED_NAMES.isdisjoint(re.split(r"[^a-z0-9]+", node.names))


def _kind(node: Node) -> str:
    return node.tag if node.tag in ("article", "main") else "main" if node.role == "main" else ""


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found.group(1).lower() if found else ""


def subtree_names(host: str, page: str, root: Node) -> dict[int, int]:
    """Name of every subtree on its host: a hash of its start, its text with white space evened out, and its children."""
    digests: dict[int, bytes] = {}
    for node in reversed(list(nodes(root))):  # children come before their parents
        start = " ".join([node.tag, node.role, *sorted(set(node.classes.split()))])
        tree = xxhash.xxh3_128(start.encode("utf-8", "surrogatepass"))
        raw = page[node.opened : node.end] if node.tag in RAW else ""
        for part in node.parts if not raw else (raw,):
            if isinstance(part, Node):
                tree.update(b"\1" + digests[id(part)])
            elif flat := _flat(part):
                tree.update(b"\0" + flat)
        digests[id(node)] = tree.digest()
    return {number: xxhash.xxh64_intdigest(_flat(host) + b"\n" + digest) for number, digest in digests.items()}


def _flat(piece: str) -> bytes:
    return " ".join(piece.split()).encode("utf-8", "surrogatepass")


class Page:
    """One page: which elements are unwanted, where its main text is."""

    def __init__(self, url: str | None, page: str, templates: frozenset[int] = frozenset()):
        self.page, self.host = page, host_of(url)
        self.root = parse(page)
        self.dropped: set[int] = set()
        mains: dict[str, list[Node]] = {"article": [], "main": [], "body": []}
        holders = self._holders()
        bearers = self._bearers()
        stack = [(self.root, False)]
        self.candidates: list[Node] = []
        while stack:
            node, inside = stack.pop()
            if node is not self.root:
                unwanted = _never_text(node) or _unwanted_name(node) and id(node) not in bearers
                if id(node) not in holders and unwanted and not (inside is False and node.tag in KEPT_TAGS):
                    self.dropped.add(id(node))
                if node.tag not in KEPT_TAGS | INLINE | VOID and not (inside and node.tag in FLOW):
                    self.candidates.append(node)
                if id(node) in self.dropped:
                    continue
                kind = "main" if node.role == "main" and node.tag != "article" else node.tag
                if kind in mains and not inside:
                    mains[kind].append(node)
                    inside = inside or kind == "article"
            stack.extend((part, inside) for part in reversed(node.parts) if isinstance(part, Node))
        self.main = mains["article"] or mains["main"][:1] or mains["body"][:1] or [self.root]
        self.names: dict[int, int] = {}
        if templates:
            self.names = self._names()
            self.dropped |= {number for number, name in self.names.items() if name in templates and number not in holders}

    def _names(self) -> dict[int, int]:
        names = subtree_names(self.host, self.page, self.root)
        return {id(node): names[id(node)] for node in self.candidates}

    def _holders(self) -> set[int]:
        """The nodes around the first article (or main) that is not in a menu, sidebar or the like by its tag."""
        for node in nodes(self.root):
            if node.tag in ("article", "main") or node.role == "main":
                around, parent = [], node.parent
                while parent is not None and parent.tag not in DROPPED_TAGS and parent.role not in DROPPED_ROLES:
                    around.append(id(parent))
                    parent = parent.parent
                if parent is None:
                    return set(around)
        return set()

    def _bearers(self) -> set[int]:
        """Nodes with an unwanted name that hold most of the running text of the article (main, page) around them.

        Links are no running text, and the text of an article or main counts for that alone.
        """
        order = list(nodes(self.root))
        named = [node for node in order if _unwanted_name(node)]
        if not named:
            return set()
        sizes: dict[int, int] = {}
        for node in reversed(order):  # children come before their parents
            size = 0
            if not _never_text(node) and node.tag != "a":
                for part in node.parts:
                    if isinstance(part, str):
                        size += len("".join(part.split()))
                    elif not _kind(part):
                        size += sizes[id(part)]
            sizes[id(node)] = size
        kinds, stack = set(), [self.root]
        while stack:
            node = stack.pop()
            if not _never_text(node):
                kinds.add(_kind(node))
                stack.extend(part for part in node.parts if isinstance(part, Node))
        shown = "article" if "article" in kinds else "main" if "main" in kinds else ""
        found = set()
        for node in named:
            around = node.parent
            while around is not self.root and not _kind(around):
                around = around.parent
            if _kind(around) == shown and 2 * sizes[id(node)] > sizes[id(around)]:
                found.add(id(node))
        return found

    def text(self) -> str:
        """Blocks of the main text, decoded and joined by an empty line."""
        blocks: list[str] = []
        pieces: list[str] = []

        def flush() -> None:
            if pieces:
                block = " ".join(html.unescape("".join(pieces)).split())
                pieces.clear()
                if block:
                    blocks.append(block)

        for main in self.main:
            stack: list = [main]
            while stack:
                part = stack.pop()
                if part is None:
                    flush()
                elif isinstance(part, str):
                    pieces.append(part)
                elif id(part) not in self.dropped:
                    if part.tag == "br":
                        pieces.append(" ")
                        continue
                    if part.tag not in INLINE:
                        flush()
                        stack.append(None)
                    stack.extend(reversed(part.parts))
            flush()
        return "\n\n".join(blocks)

    def template_names(self, main_length: int) -> list[int]:
        """Names of the subtrees that may be templates: not those that hold half of the main text."""
        found, names = set(), self._names()
        sizes: dict[int, int] = {}
        for node in reversed(list(nodes(self.root))):  # children come before their parents
            sizes[id(node)] = sum(len(part.strip()) if isinstance(part, str) else sizes[id(part)] for part in node.parts)
        for node in self.candidates:
            if id(node) in self.dropped or 2 * sizes[id(node)] < main_length:
                found.add(names[id(node)])
        return sorted(found)


def _page_key(url: Column, page: Column) -> Column:
    """Names a page by what it is, so that pages without an id do not meet under one key."""
    nothing = F.lit("")
    return F.unhex(F.md5(F.concat_ws("\n", F.coalesce(url, nothing), F.coalesce(page, nothing))))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: each page's host and a hash of its main text, and names of its subtrees."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            rows = batch.slice(start, 256)
            hosts, mains, names, counts = [], [], [], []
            for url, page in zip(rows.column("url").to_pylist(), rows.column("html").to_pylist()):
                hosts.append(xxhash.xxh64_intdigest(_flat(host_of(url))))
                if not page:
                    mains.append(0)
                    counts.append(0)
                    continue
                read = Page(url, page)
                text = read.text()
                mains.append(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))
                own = read.template_names(len(text))
                names += own
                counts.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("key"),
                    pa.array(np.array(hosts, dtype=np.uint64).view(np.int64)),
                    pa.array(np.array(mains, dtype=np.uint64).view(np.int64)),
                    list_array(np.array(names, dtype=np.uint64).view(np.int64), np.array(counts)),
                ],
                names=["key", "host", "main", "names"],
            )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [press.compress((page or "").encode()) for page in batch.column("html").to_pylist()]
        columns = [batch.column(name) for name in ("page_id", "url", "key")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], names=["page_id", "url", "key", "packed"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            rows = batch.slice(start, 256)
            texts = []
            for url, packed, names in zip(*(rows.column(c).to_pylist() for c in ("url", "packed", "templates"))):
                page = press.decompress(packed).decode()
                templates = frozenset(name & 0xFFFFFFFFFFFFFFFF for name in names or ())
                texts.append(Page(url, page, templates).text() if page else "")
            yield pa.RecordBatch.from_arrays(
                [rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )


def site_templates(named: DataFrame, min_pages: int, share: float) -> DataFrame:
    """Names (each is one subtree on one host) on enough of their host's pages with different main texts.

    Enough is ``share`` of them, but ``min_pages`` at least.
    """
    hosts = named.groupBy("host").agg(F.count_distinct("main").alias("pages"))
    pairs = named.select("host", "main", F.explode("names").alias("name"))
    counted = pairs.groupBy("name").agg(F.min("host").alias("host"), F.count_distinct("main").alias("n"))
    recurring = counted.where(F.col("n") >= min_pages).join(hosts, "host")
    return recurring.where(F.col("n") >= F.col("pages") * share).select("name")


def extract(pages: DataFrame, min_pages: int = 4, share: float = 0.01) -> DataFrame:
    """``page_id, url, text`` of every row of ``pages`` (``page_id, url, html``)."""
    keyed = pages.select("page_id", "url", "html", _page_key(F.col("url"), F.col("html")).alias("key"))
    named = materialized(
        keyed.select("key", "url", "html").mapInArrow(_named, "key binary, host long, main long, names array<long>"), "subtrees"
    )
    templates = site_templates(named, min_pages, share)
    found = (
        named.select("key", F.explode("names").alias("name"))
        .join(templates, "name")
        .groupBy("key")
        .agg(F.collect_set("name").alias("templates"))
    )
    packed = keyed.mapInArrow(_packed, "page_id long, url string, key binary, packed binary")
    return (
        packed.join(found, "key", "left")
        .select("page_id", "url", "packed", "templates")
        .mapInArrow(_extracted, "page_id long, url string, text string")
    )
