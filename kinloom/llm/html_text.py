r"""Main text of web pages by consensus of a host's pages.

Each page's containers are scored by the text inside them that isn't link text. The search goes from the
page down: into the container that holds ``MOST`` of what is around it, as long as nothing else around it
is text of its own; a ``main`` or ``article`` with a quarter of the page is taken whole. So a title beside
sections, and sections beside each other, stay together. The container's generalised path (tags with
their classes, lower-cased, digits as ``0``; carried as a hash of the path around it and its own step) is the
page's vote, weighted by its share of the page in thousandths. Spark adds the votes by host and path; each
host's winning path then says which containers of its pages are extracted. A page without such a
container, or with no text there, falls back on its own best one.

Blocks keep page order and are joined by one \n. Character references are decoded, white space inside a
block becomes one space. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments are left out by tag, role, or class and id words; a paragraph only by words that
can't mean its contents. An unclosed comment, script or style reaches to the page's end; a ``<`` that no
``>`` follows is text. Time and memory are in proportion to the page, however tags are nested or broken.

The winners have one row a host. They are broadcast only when their measured size is below
``BROADCAST_BYTES``; beyond it they are joined by a shuffle, where adaptive execution splits hot hosts.

Defined results: a null html counts as empty and gives an empty text; pages without a host vote as the
host ``""``; repeated rows are extracted one by one.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.store import keep, small_batches
from kinloom.llm.url_filter import with_host_and_path

BROADCAST_BYTES = 8 << 20

# The elements and words that HTML pages use for what isn't main text, and block elements.
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
DROPPED = frozenset("nav header footer aside form button select option dialog menu svg math canvas object audio video head fieldset".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar side menu menus nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer comment comments commentlist disqus respond reply replies discussion share sharing social newsletter subscribe subscription signup login related recommended "
    "recommendations widget toolbar pagination pager search copyright".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody thead tfoot table ul ol dl figure figcaption caption address summary details center".split())
CLOSES_ITSELF = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = frozenset("ul ol dl table article section div main body".split())
PROSE = frozenset("p li blockquote pre td th dd dt figcaption".split())
PLAIN_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsored cookie cookies consent gdpr newsletter subscribe subscription signup copyright comment comments".split())
KEPT = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
DENIALS = frozenset("no not non has with without".split())

#: Share of a container's text that the search follows into one container inside it.
MOST = 0.9

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}


@dataclass(slots=True, eq=False)
class Node:
    """An open element; ``near`` is the nearest one, itself included, that closes itself or limits that."""

    tag: str
    path: str
    parent: Node | None
    dropped: bool
    main: bool
    inside: bool
    around: Node | None = None
    near: Node | None = None
    direct: int = 0
    worth: int = 0


@dataclass(slots=True)
class Block:
    text: str
    node: Node
    linked: int


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(source)} if source else {}


def _words(names: str) -> set[str]:
    """Words of class and id names, without names such as ``no-sidebar``."""
    split = map(_WORD.findall, names.lower().split())
    return {w for words in split if words and words[0] not in DENIALS for w in words}


class _Tags:
    """Tags of a page from left to right; each search that finds nothing is made once."""

    def __init__(self, page: str) -> None:
        self.page, self.none = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none.add(what)
        return found

    def end(self, at: int) -> int:
        """Where the tag that is open at ``at`` ends: at a ``>`` outside of quotes, if there is one, or the first."""
        first = self.find(">", at)
        while first >= 0:
            at = _PLAIN.match(self.page, at).end()
            if at >= len(self.page):
                return first
            if self.page[at] == ">":
                return at
            at = self.find(self.page[at], at + 1) + 1
            if not at:
                return first
        return -1


def parse(page: str | None, path: str | None = None) -> list[Block]:
    """The blocks of text outside of what is dropped, in page order; ``path`` marks the nodes inside it."""
    page = page or ""
    top = Node("", "", None, False, False, path == "")
    top.around = top.near = top
    node, blocks, parts, linked, links = top, [], [], 0, 0
    tags, opened, at = _Tags(page), Counter(), 0

    def flush():
        nonlocal linked
        if parts:
            if not node.dropped and (text := _SPACE.sub(" ", "".join(parts)).strip()):
                blocks.append(Block(text, node, min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(piece):
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if links:
                linked += len(piece)

    def leave(up):
        nonlocal node
        while node is not up:
            opened[node.tag] -= 1
            node = node.parent

    while (begin := page.find("<", at)) >= 0:
        if page.startswith("<!--", begin):
            add(page[at:begin])
            short = next((x for x in ("<!-->", "<!--->") if page.startswith(x, begin)), None)
            end = begin + len(short) - 3 if short else tags.find("-->", begin + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?"), begin):
            add(page[at:begin])
            end = tags.find(">", begin)
            at = end + 1 if end >= 0 else len(page)
            continue
        name = _NAME.match(page, begin + 1)
        end = tags.end(name.end()) if name else -1
        if end < 0:  # no tag: text up to the next one
            more = page.find("<", begin + 1) if ">" not in tags.none else -1
            add(page[at : more if more >= 0 else len(page)])
            at = more if more >= 0 else len(page)
            continue
        add(page[at:begin])
        at = end + 1
        closing, tag, source = name[1], name[2].lower(), page[name.end() : end]
        if tag in RAW:
            if not closing:
                over = _RAW_END[tag].search(page, at)
                at = over.end() if over else len(page)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append("\n")
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        flush()
        if closing:
            links = 0
            if opened[tag]:
                up = node
                while up.tag != tag:
                    up = up.parent
                leave(up.parent)
            continue
        shut = CLOSES_ITSELF.get(tag, ("p",))
        up = node.near
        while up.tag and up.tag not in LIMITS and up.tag not in shut:
            up = up.parent.near
        if up.tag in shut:
            leave(up.parent)
        found = _attributes(source)
        role, name_words = found.get("role", "").lower(), f"{found.get('class', '')} {found.get('id', '')}"
        dropped = node.dropped or tag in DROPPED or "hidden" in found
        if found and not dropped and tag not in KEPT:
            dropped = bool((PLAIN_WORDS if tag in PROSE else WORDS).intersection(_words(name_words))) or role in ROLES
        classes = sorted(set(_DIGITS.sub("0", found.get("class", "").lower()).split())) if found else ()
        way = xxhash.xxh64_hexdigest(f"{node.path}/{'.'.join([tag, *classes])}".encode("utf-8", "surrogatepass"))
        node = Node(tag, way, node, dropped, tag in ("main", "article") or role == "main", node.inside or way == path)
        node.around = node if tag not in PARAGRAPHS else node.parent.around
        node.near = node if tag in LIMITS or tag in CLOSES_ITSELF else node.parent.near
        opened[tag] += 1
    add(page[at:])
    flush()
    return blocks


def best(blocks: list[Block]) -> tuple[str, int]:
    """The path of the best container and its weight: its share of the page's text in thousandths."""
    known: dict[int, Node] = {}
    for b in blocks:
        near, worth = b.node.around, len(b.text) - b.linked
        near.worth += worth
        near.direct += worth if 2 * worth >= len(b.text) else 0
        while near is not None and id(near) not in known:
            known[id(near)] = near
            near = near.parent.around if near.parent is not None else None
    worth, direct, inside, mains = Counter(), Counter(), {}, Counter()
    depth: dict[int, int] = {}
    for n in known.values():  # depth by way of the nearest known one
        way = []
        while n is not None and id(n) not in depth:
            way.append(n)
            n = n.parent.around if n.parent is not None else None
        base = depth[id(n)] if n is not None else -1
        for i, x in enumerate(reversed(way), 1):
            depth[id(x)] = base + i
    for n in sorted(known.values(), key=lambda x: -depth[id(x)]):
        worth[n.path] += n.worth
        direct[n.path] += n.direct
        if n.parent is not None:
            far = n.parent.around
            far.worth += n.worth
            inside.setdefault(far.path, set()).add(n.path)
            if n.main:
                mains[n.path] = depth[id(n)]
    total = worth[""]
    if not total:
        return "", 0
    path, entries = "", [p for p in mains if 4 * worth[p] >= total]
    if entries:
        path = min(entries, key=lambda p: (mains[p], -worth[p], p))
    else:
        while inside.get(path) and not direct[path]:
            largest = max(inside[path], key=lambda p: (worth[p], p))
            if worth[largest] < MOST * worth[path]:
                break
            path = largest
    return path, max(1, 1000 * worth[path] // max(1, sum(len(b.text) for b in blocks)))


def extract(page: str | None, path: str | None) -> str:
    """Text of the containers of that path; of the page's own best one if there is none."""
    blocks = parse(page, path)
    found = [b.text for b in blocks if b.node.inside]
    if not found and blocks:
        own, _ = best(blocks)
        found = [b.text for b in parse(page, own) if b.node.inside]
    return "\n".join(found)


def votes(pages: DataFrame) -> DataFrame:
    """``host, path, weight``: one row for each page with text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(h, *best(parse(x))) for h, x in zip(batch["host"], batch["html"], strict=True)]
            yield pd.DataFrame([r for r in rows if r[2] > 0], columns=["host", "vote", "weight"])

    return with_host_and_path(pages.select("url", "html")).select("host", "html").mapInPandas(run, "host string, vote string, weight long")


def consensus(pages: DataFrame) -> DataFrame:
    """``host, winner``: the path with most weight; of equal ones the last in order."""
    tally = votes(pages).groupBy("host", "vote").agg(F.sum("weight").alias("weight"))
    return tally.groupBy("host").agg(F.max(F.struct("weight", "vote"))["vote"].alias("winner"))


def main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    small_batches(pages.sparkSession)
    winners = keep(consensus(pages), "host-paths")
    size = winners.agg(F.sum(F.octet_length("host") + F.octet_length("winner") + 16)).first()[0] or 0
    own = with_host_and_path(pages.select("page_id", "url", "html")).drop("path")
    joined = own.join(F.broadcast(winners) if size <= broadcast_bytes else winners, "host", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [extract(x, w) for x, w in zip(batch["html"], batch["winner"], strict=True)]
            batch["n_chars"] = batch["text"].map(len)
            yield batch[["page_id", "url", "text", "n_chars"]]

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "winner").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")


def op8(spark, sf_dir: str) -> DataFrame:
    from kinloom.llm.tables import table

    return main_text(table(spark, sf_dir, "pages"))
