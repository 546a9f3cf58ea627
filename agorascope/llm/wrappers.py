"""Main texts of web pages by wrapper induction.

Pages of a host are made from the same templates. Each page's DOM tree is folded (siblings with the
same label become one repeated node) and aligned with the host's wrapper by simple tree matching:
the largest mapping that keeps labels, parents and the order of siblings. Aligned nodes are merged
and the others added, so the wrapper holds every node of the host's pages, how many pages had it, and
whether its text was always the same. Wrappers are built per task over all its pages and the partial
ones merged, so every page counts and no host meets in one task as a whole.

A page is then aligned with its host's wrapper. Nodes whose text never varies over COMMON pages or
more are template, folded siblings one by one; varying slots are content, unless their tag, class or id
marks them as something beside the article, or they consist of links outside it. If the page has an
article or a main element, content comes from there, and a constant text in it is template only if the
page has it outside as well. Copies of a page are one page of its wrapper. A class or id never marks inline
elements, the page's own elements (html, body, main, an article outside others) or, in these, paragraphs and
other blocks of text, nor a box that holds most of the page's text and, if it has any, its article, main
element or heading.

Elements nested over MAX_DEPTH deep become children of the element at that depth, as in browsers. The
children of a wrapper's node are counted with bounded loss: one that was seen on fewer than one in RARE
pages of the node may be forgotten and counted anew, so its count is short by one in RARE at most.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorascope.llm.store import small, written

COMMON = 4  # pages from which on an unvarying text is template
MAX_DEPTH = 256
RARE = 64
SALTS = 16
BROADCAST_BYTES = 16 << 20  # wrappers up to this size are broadcast

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr br img".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = set("html body table ul ol dl article section div main aside nav header footer form blockquote td th".split())
_NEVER = set(
    "head title script style noscript template nav footer aside form button select textarea iframe object svg canvas "
    "dialog menu input fieldset".split()
)
_MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|sidebar|side|aside|menu|navbar|nav|"
    r"navigation|breadcrumbs?|footer|masthead|topbar|comments?|respond|replies|disqus|cookies?|consent|notice|notices|alert|popup|modal|overlay|"
    r"share|sharing|social|related|recommended|subscribe|newsletter|signup|login|search|widget|pagination|pager|toolbar|skip|legal|copyright)"
    r"(?:$|[\s_-])|comment|cookie|advert"
)
_TEXT = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd tr td th caption figcaption address summary".split())
_OWN = {"html", "body", "main"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"}
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    label: str = ""
    marked: bool = False
    named: bool = False  # marked by its class or id only
    children: list = field(default_factory=list)  # nodes and texts in page order


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#page", "#page")
        self.stack = [self.root]
        self.open: dict[str, int] = defaultdict(int)  # tags on the stack

    def _cut(self, i: int) -> None:
        while len(self.stack) > i:
            self.open[self.stack.pop().tag] -= 1

    def _close(self, tags: set[str], scope: set[str]) -> None:
        for tag in tags:
            if self.open[tag]:
                break
        else:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                self._cut(i)
                return
            if self.stack[i].tag in scope:
                return

    def _may_be_marked(self, tag: str) -> bool:
        if tag in _OWN or tag in _INLINE or tag == "article" and not self.open["article"]:
            return False
        return not (tag in _TEXT and (self.open["article"] or self.open["main"]))

    def _add(self, child: Node | str) -> None:
        self.stack[min(len(self.stack), MAX_DEPTH) - 1].children.append(child)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _INLINE:
            if self.open["p"]:
                self._close({"p"}, _SCOPE)
            if tag in _CLOSES:
                self._close(_CLOSES[tag], {"ul", "ol", "dl", "table", "select"})
        own = {k: v or "" for k, v in attrs}
        name = f"{own.get('class', '')} {own.get('id', '')}".strip().lower() if own else ""
        fixed = tag in _NEVER or own.get("role", "") in _ROLES and tag not in _OWN or "hidden" in own
        named = bool(name) and not fixed and self._may_be_marked(tag) and bool(_MARKED.search(name))
        label = tag + "." + re.sub(r"\d+", "0", name) if name else tag
        node = Node(tag, label, fixed or named, named)
        self._add(node)
        if tag not in _VOID:
            self.stack.append(node)
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.stack[-1].tag == tag:
            self._cut(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._cut(i)
                return

    def handle_data(self, data: str) -> None:
        self._add(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    _unmark(builder.root)
    return builder.root


def _unmark(root: Node) -> None:
    """Takes the marks by name off boxes that hold most of the page's text and what it is about."""
    sizes: dict[int, tuple[int, bool]] = {}

    def size(node: Node) -> tuple[int, bool]:
        chars, core = 0, node.tag in {"main", "h1"} or node.tag == "article" and not node.named
        for child in node.children:
            if isinstance(child, str):
                chars += len(child.strip())
            elif not child.marked or child.named:
                n, c = size(child)
                chars, core = chars + n, core or c
        sizes[id(node)] = chars, core
        return chars, core

    total, any_core = size(root)
    work = [root]
    while work:
        node = work.pop()
        chars, core = sizes[id(node)]
        if node.named and 2 * chars > total and (core or not any_core):
            node.marked = node.named = False
        work += [c for c in node.children if isinstance(c, Node) and id(c) in sizes and (not node.marked)]


@dataclass
class Slot:
    """A node of a wrapper, or of one folded page (pages = 1)."""

    label: str
    text: tuple[int, ...] | None = None  # hashes of the nodes' texts that all pages had, None if there are none
    pages: int = 1
    chars: int = 0
    children: list = field(default_factory=list)
    missed: int = 0  # on how many pages more it may have been


def dumps(root: Slot) -> bytes:
    """A wrapper as bytes: its nodes in page order, each with its number of children."""
    flat, work = [], [root]
    while work:
        slot = work.pop()
        flat.append((slot.label, slot.text, slot.pages, slot.chars, slot.missed, len(slot.children)))
        work += reversed(slot.children)
    return pickle.dumps(flat)


def loads(raw: bytes) -> Slot:
    top = Slot("")
    work = [(top, 1)]  # nodes that wait for so many children
    for label, text, pages, chars, missed, n in pickle.loads(raw):
        parent, left = work.pop()
        slot = Slot(label, text, pages, chars, [], missed)
        parent.children.append(slot)
        if left > 1:
            work.append((parent, left - 1))
        if n:
            work.append((slot, n))
    return top.children[0]


def _own_text(node: Node) -> str:
    return " ".join(_SPACE.sub(" ", c).strip() for c in node.children if isinstance(c, str)).strip()


def _telling(node: Node, siblings: list[Node]) -> bool:
    """Whether a constant text makes the node template: of folded siblings, only whole blocks of text
    do, as words in inline elements or between them recur within sentences."""
    return len(siblings) == 1 or node.tag not in _INLINE and all(isinstance(c, str) for c in node.children)


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _folded(nodes: list[Node], owner: dict[int, list[Node]]) -> Slot:
    """One slot for same-label siblings; ``owner`` lists each slot's nodes by its identity."""
    texts = [_own_text(n) for n in nodes]
    own = sorted({_hash(t) for n, t in zip(nodes, texts) if _telling(n, nodes)})
    slot = Slot(nodes[0].label, tuple(own) or None, 1, sum(map(len, texts)))
    owner[id(slot)] = nodes
    groups: dict[str, list[Node]] = {}
    for node in nodes:
        for child in node.children:
            if isinstance(child, Node) and not child.marked:
                groups.setdefault(child.label, []).append(child)
    slot.children = [_folded(g, owner) for g in groups.values()]
    return slot


def match(a: Slot, b: Slot) -> tuple[int, list[tuple[int, int]]]:
    """Size of the largest simple tree matching of two slots with equal labels, and the pairs of
    children (by number) it maps."""
    n, m = len(a.children), len(b.children)
    if not n or not m:
        return 1, []
    size = [[match(x, y)[0] if x.label == y.label else 0 for y in b.children] for x in a.children]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + size[i][j])
    pairs, i, j = [], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return 1 + best[n][m], pairs[::-1]


def merge(wrapper: Slot, other: Slot) -> Slot:
    """``wrapper`` with ``other``, a page or a wrapper of the same host, aligned and added."""
    _, pairs = match(wrapper, other)
    before, added = wrapper.pages // RARE, other.pages // RARE
    wrapper.pages += other.pages
    wrapper.chars += other.chars
    wrapper.missed += other.missed
    if wrapper.text != other.text:
        wrapper.text = tuple(t for t in wrapper.text or () if t in set(other.text or ())) or None
    taken, known, children, at = dict((j, i) for i, j in pairs), {i for i, _ in pairs}, [], 0
    if added:
        for i, child in enumerate(wrapper.children):
            child.missed += added if i not in known else 0
    for j, child in enumerate(other.children):
        if j in taken:
            children += wrapper.children[at : taken[j]]
            children.append(merge(wrapper.children[taken[j]], child))
            at = taken[j] + 1
        else:
            child.missed += before
            children.append(child)
    wrapper.children = children + wrapper.children[at:]
    if (now := wrapper.pages // RARE) != before:
        wrapper.children = [c for c in wrapper.children if c.pages + c.missed > now]
    return wrapper


def main_text(root: Node, wrapper: Slot | None) -> str:
    """The text blocks of a page that its host's wrapper makes content."""
    owner: dict[int, list[Node]] = {}
    page = _folded([root], owner)
    template: set[int] = set()  # nodes with a constant text
    total = wrapper.pages if wrapper else 1

    def label(slot: Slot, known: Slot | None) -> None:
        if known is not None and known.text is not None and COMMON <= known.pages and 2 * known.pages > total:
            nodes = owner[id(slot)]
            template.update(id(n) for n in nodes if _telling(n, nodes) and (t := _own_text(n)) and _hash(t) in known.text)
        if known is not None:
            for i, j in match(known, slot)[1]:
                label(slot.children[j], known.children[i])

    if wrapper is not None:
        label(page, wrapper)
    bodies = _bodies(root)
    if template and bodies != [root]:
        inside = [n for n in _nodes(bodies, set()) if id(n) in template]
        outside = {_own_text(n) for n in _nodes([root], set(map(id, bodies)))} if inside else set()
        template -= {id(n) for n in inside if _own_text(n) not in outside}
    blocks: list[str] = []
    part: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(part)).strip()
        part.clear()
        if text:
            blocks.append(text)

    def walk(node: Node) -> None:
        block = node.tag not in _INLINE
        if block:
            flush()
        constant = id(node) in template
        for child in node.children:
            if isinstance(child, str):
                if not constant:
                    part.append(child)
            elif child.tag == "br":
                part.append(" ")
            elif child.marked:
                if child.tag not in _INLINE:
                    flush()
            elif child.tag == "header" and not _within(bodies):
                flush()
            elif not _within(bodies) and _links(child):
                flush()
            else:
                walk(child)
        if block:
            flush()

    def _within(found: list[Node]) -> bool:
        return found != [root]

    for body in bodies:
        walk(body)
    flush()
    return "\n".join(blocks)


def _nodes(tops: list[Node], without: set[int]) -> Iterator[Node]:
    """The nodes under ``tops``, these included, but for subtrees ``without``, by identity."""
    work = list(tops)
    while work:
        node = work.pop()
        if id(node) not in without:
            yield node
            work += [c for c in node.children if isinstance(c, Node)]


def _bodies(root: Node) -> list[Node]:
    """The outermost article elements, else main elements, else the page."""
    for wanted in ("article", "main"):
        found: list[Node] = []
        work = [root]
        while work:
            node = work.pop()
            if node.tag == wanted or wanted == "main" and node.label.startswith("div.") and re.search(r"\bmain\b", node.label):
                found.append(node)
                continue
            work += [c for c in reversed(node.children) if isinstance(c, Node) and not c.marked]
        if found:
            return found
    return [root]


def _links(node: Node) -> bool:
    """A list or box whose text is mostly that of links."""

    def size(n: Node, inside: bool) -> tuple[int, int]:
        linked = all_ = 0
        for c in n.children:
            if isinstance(c, str):
                k = len(c.strip())
                all_, linked = all_ + k, linked + k * inside
            elif not c.marked:
                a, b = size(c, inside or c.tag == "a")
                all_, linked = all_ + a, linked + b
        return all_, linked

    if node.tag not in {"ul", "ol", "div", "section", "table", "dl"}:
        return False
    all_, linked = size(node, False)
    return all_ > 0 and 2 * linked > all_


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


WRAPPERS = "host string, wrapper binary"


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wrappers: dict[str, Slot] = {}
    for batch in batches:
        for host, html in zip(batch.column("host"), batch.column("html")):
            host, page = host.as_py(), _folded([parse(html.as_py() or "")], {})
            wrappers[host] = merge(wrappers[host], page) if host in wrappers else page
            if len(wrappers) > 2000:  # partial wrappers may be given out at any time
                yield _rows(wrappers)
                wrappers = {}
    yield _rows(wrappers)


def _rows(wrappers: dict[str, Slot]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(list(wrappers), pa.string()), pa.array([dumps(w) for w in wrappers.values()], pa.binary())],
        names=["host", "wrapper"],
    )


def _merge_all(table: pa.Table) -> pa.Table:
    merged: Slot | None = None
    for raw in sorted(table.column("wrapper").to_pylist()):  # in a fixed order, whatever the shuffle
        other = loads(raw)
        merged = other if merged is None else merge(merged, other)
    return pa.table({"host": [table.column("host")[0].as_py()], "wrapper": [dumps(merged)]})


def distinct_pages(pages: DataFrame) -> DataFrame:
    """host, html of each distinct page of a host; pages that differ only in the attributes of their
    tags or in white space are copies. Only pages that have copies are shuffled."""
    bare = F.regexp_replace(F.regexp_replace("html", r"<([A-Za-z][A-Za-z0-9]*)\s[^>]*>", "<$1>"), r"\s+", " ")
    keyed = pages.select("host", "html", F.coalesce(F.xxhash64(bare), F.lit(0).cast("long")).alias("key"))
    keys = keyed.groupBy("host", "key").count().where("count > 1").select("host", "key")
    copied = small(written(keys, "copied-pages"))
    once = keyed.join(copied, ["host", "key"], "left_anti")
    copies = keyed.join(copied, ["host", "key"], "left_semi").groupBy("host", "key").agg(F.min("html").alias("html"))
    return once.select("host", "html").unionByName(copies.select("host", "html"))


def induced(pages: DataFrame) -> DataFrame:
    """One wrapper per host of ``pages`` (host, html): partial wrappers of the tasks, merged first
    in SALTS groups per host and then by host."""
    partial = distinct_pages(pages).select("host", "html").mapInArrow(_induce, WRAPPERS)
    salted = partial.withColumn("salt", F.pmod(F.crc32("wrapper"), F.lit(SALTS)))
    first = salted.groupBy("host", "salt").applyInArrow(_merge_all, WRAPPERS)
    return first.groupBy("host").applyInArrow(_merge_all, WRAPPERS)


TEXTS = "page_id long, url string, text string"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[bytes | None, Slot | None] = (None, None)
    for batch in batches:
        texts = []
        for html, raw in zip(batch.column("html"), batch.column("wrapper")):
            raw = raw.as_py()
            if raw != last[0]:
                last = raw, loads(raw) if raw else None
            texts.append(main_text(parse(html.as_py() or ""), last[1]))
        yield pa.record_batch(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of ``pages`` (page_id, url, html).

    A null or empty page has an empty text; pages whose url has no host are pages of one host, the
    empty name; null and repeated ids are kept; other columns are ignored.
    """
    chosen = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        host_of(F.col("url")).alias("host"),
        F.col("html").cast("string").alias("html"),
    )
    wrappers = written(induced(chosen), "wrappers")
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        joined = chosen.join(F.broadcast(wrappers), "host", "left")
    else:  # spread the pages of a host over SALTS tasks
        salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
        salt = F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)).cast("int")
        joined = chosen.withColumn("salt", salt).join(wrappers.select("host", "wrapper", salts), ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(_extract, TEXTS)
