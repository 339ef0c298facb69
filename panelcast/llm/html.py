"""Main text of web pages by wrapper induction.

Pages are parsed to trees of block elements; runs of alike siblings count as one node. Per host, the most frequent
tree is the wrapper's seed, and every other tree of the host is aligned with it by simple tree matching. Texts that
stay the same at an aligned node over most of the host's distinct pages are template; the varying slots are content,
save those whose element says otherwise (menus, adverts, forms, footers and the like). Where a page marks its article,
only slots in it are content.

Names of classes are evidence beside the template: a part named like an advert or like comments goes; where such a word is
only one of several, or the name is of related pages, a notice or a header, only if the part is mostly links or has fields.
Position decides against names: a form or named part that holds the page's articles, or all that is left of a page without
one, is a frame of the page and stays. Elements that are hidden go.

Only trees (as strings), node numbers and text hashes are shuffled; the induction's statistics cover all pages. A host's
template has at most twice as many texts as its pages have on average, as each is on half of the pages or more.
"""

from __future__ import annotations

import bisect
import functools
import html as entities
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.shared import staged

#: A text is template if so many of the host's distinct pages have it at one node: outside an article, and inside.
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.5
ARTICLE_PAGES, ARTICLE_SHARE = 8, 0.8
#: A slot outside an article with more of its characters in links than this is a menu.
LINK_SHARE = 0.6
#: Cells of the table by which two lists of children are matched at once; longer lists are cut at children that are equal
#: and unique in both.
CELLS = 40_000
#: Templates of at most so many bytes together are sent to every executor.
BROADCAST_BYTES = 64_000_000
#: Trees may be as deep as pages make them.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))

#: Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
DROPPED = frozenset("head title script style noscript template iframe object svg math canvas nav footer aside form button select textarea menu dialog".split())
RAW = frozenset("script style noscript template iframe svg math textarea title".split())
ARTICLE = frozenset("article main".split())
FIELDS = frozenset("input select textarea button".split())
#: Words in the names (class, id, role) of parts that are no content, and of those that often are not.
NO_CONTENT = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion cookie cookies consent popup modal sidebar menu nav navbar navigation breadcrumb
    breadcrumbs footer masthead comment comments respond replies share sharing social newsletter subscribe login pagination pager""".split()
)
MAYBE_CONTENT = frozenset("header banner notice notices related recommended search widget widgets".split())
#: Words beside such a word in a name that is still one of such a part.
OF_A_PART = frozenset(
    """section list area block box container wrapper wrap bar left right top bottom site page main global primary secondary inner outer form buttons button links link icons icon signup
    widget banner slot unit row panel overlay thread item items notice content side header head title body desktop mobile sticky fixed""".split()
)
#: Elements in which a text that is mostly a link is still a text.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd td".split())
#: Words before such a word that make the name one of a page that has, or has not, the part.
OF_A_PAGE = frozenset("no not non has with without is and plus".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<close2>/?)(?P<tag2>[A-Za-z][A-Za-z0-9:-]*)(?P<rest2>[^>]*+)>",
    re.S,
)
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')")


@dataclass
class Node:
    label: str
    children: list[Node] = field(default_factory=list)
    units: list[int] = field(default_factory=list)


@dataclass
class Unit:
    """A stretch of text within one block element."""

    text: str
    linked: int
    dropped: bool
    article: bool
    tag: str
    node: int = -1


def _names(rest: str) -> list[str]:
    """The words of an element's class, id and role."""
    if not rest.strip():
        return []
    return sorted({re.sub(r"[^\w-]", "", re.sub(r"[0-9]+", "0", w)) for m in _NAMED.finditer(rest) for w in (m[1] or m[2] or m[3] or "").split()} - {""})


@functools.lru_cache(65_536)
def _part(name: str) -> str:
    """What a name says of its element: "no" content, "maybe" content, or nothing."""
    words = [w for w in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])", name) if w]
    words = [w.lower() for w in words]
    if OF_A_PAGE & set(words):
        return ""
    named = NO_CONTENT & set(words)
    if (named and set(words) <= NO_CONTENT | OF_A_PART) or (len(words) == 1 and words[0] in MAYBE_CONTENT):
        return "no"
    return "maybe" if named or MAYBE_CONTENT & set(words) else ""


def _hidden(rest: str) -> bool:
    if "hidden" not in rest.lower() and "none" not in rest.lower():
        return False
    style = re.search(r"(?<![\w-])style\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", rest, re.I)
    return bool(style and re.search(r"display\s*:\s*none", style[1] or style[2] or style[3] or "", re.I)) or bool(re.search(r"(?<![\w-])hidden(?![\w-])", _QUOTED.sub("", rest), re.I))


@dataclass
class Frame:
    """A form or a named part: its texts' characters, in and out of links, whether it has fields to fill in, and whether an
    article, or what only a whole page has, stands in it: then it is a frame of the page, not a part beside its content."""

    kind: str
    parent: int
    form: bool
    page: bool = False
    own: int = 0
    held: int = 0
    linked: int = 0
    fields: bool = False


def parse(page: str) -> tuple[Node, list[Unit]]:
    """The page's tree of block elements and its texts in page order."""
    root = Node("page")
    units: list[Unit] = []
    # open blocks: (tag, node, dropped, article, number of the innermost form or named part around)
    stack: list[tuple[str, Node, bool, bool, int]] = [("page", root, False, False, -1)]
    opened: Counter[str] = Counter()
    within: list[int] = []
    frames: list[Frame] = []
    pieces: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(pieces)).split()) if pieces else ""
        pieces.clear()
        if text:
            stack[-1][1].units.append(len(units))
            units.append(Unit(text, linked, stack[-1][2], stack[-1][3], stack[-1][0]))
            within.append(stack[-1][4])
        linked = 0

    def close(tag: str) -> None:
        if not opened[tag]:
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                flush()
                opened.subtract(t[0] for t in stack[i:])
                del stack[i:]
                return

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            pieces.append(page[at : m.start()])
            linked += (m.start() - at) * bool(links)
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if (m["close"] or m["close2"]) else 1
            continue
        if m["close"] or m["close2"]:
            links = 0
            close(tag)
            pieces.append(" ")
            continue
        if tag in FIELDS and stack[-1][4] >= 0:
            frames[stack[-1][4]].fields = True
        if tag in VOID:
            pieces.append(" ")
            if tag == "hr":
                flush()
            continue
        rest = m["rest"] or m["rest2"] or ""
        if tag in RAW:
            if not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            pieces.append(" ")
            continue
        flush()
        links = 0
        if any(t[0] == "p" for t in stack[-2:]) and tag not in ("td", "th"):
            close("p")
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == tag:
            close(tag)
        if rest.endswith("/"):
            continue
        _, node, dropped, article, around = stack[-1]
        names = _names(rest)
        child = Node(".".join([tag, *names]))
        node.children.append(child)
        article = article or tag in ARTICLE or "main" in names
        dropped = dropped or _hidden(rest) or (tag in DROPPED and tag != "form") or (tag == "header" and not article)
        if tag not in ("html", "body"):
            said = {_part(w) for w in names}
            kind = "no" if tag == "form" or "no" in said else "maybe" if "maybe" in said else ""
            if kind:
                frames.append(Frame(kind, around, tag == "form"))
                around = len(frames) - 1
        whole = tag in ARTICLE or tag == "h1" or "main" in names
        if whole or tag in ("header", "footer", "nav"):
            k = stack[-1][4]
            while k >= 0:
                frames[k].page |= whole or frames[k].form
                k = frames[k].parent
        stack.append((tag, child, dropped, article, around))
        opened[tag] += 1
    if at < len(page):
        pieces.append(page[at:])
    flush()
    kept = [(u, f) for u, f in zip(units, within, strict=True) if not u.dropped]
    marked = any(u.article for u, _ in kept)
    beside = 0  # text that is in no part but perhaps such whose name alone does not say what it is
    for u, f in kept:
        if f >= 0:
            frames[f].held += len(u.text)
            frames[f].linked += u.linked
        while f >= 0 and frames[f].kind == "maybe":
            f = frames[f].parent
        if f >= 0:
            frames[f].own += len(u.text) * (u.article or not marked)
        elif u.article or not marked:
            beside += len(u.text)
    for f in reversed(frames):  # a part comes after those around it
        if f.parent >= 0:
            around = frames[f.parent]
            around.held, around.linked, around.fields = around.held + f.held, around.linked + f.linked, around.fields or f.fields
    gone: list[bool] = []
    left: list[int] = []  # text beside each part that stays if the part goes
    for f in frames:
        left.append(beside if f.parent < 0 else left[f.parent] + frames[f.parent].own)
        alone = f.kind == "no" or f.fields or f.linked > LINK_SHARE * f.held
        frame = f.page and not left[-1] if marked else f.page or not left[-1]
        gone.append((f.parent >= 0 and gone[f.parent]) or (alone and not frame))
    for u, f in kept:
        u.dropped = f >= 0 and gone[f]
    return root, units


def _shape(node: Node) -> tuple[str, Node]:
    """The tree's string and its form with runs of alike siblings as one."""
    kept: list[tuple[str, Node]] = []
    for one in node.children:
        form, child = _shape(one)
        if kept and kept[-1][0] == form:
            _absorb(kept[-1][1], child)
        else:
            kept.append((form, child))
    inner = f"({','.join(f for f, _ in kept)})" if kept else ""
    return node.label + inner, Node(node.label, [c for _, c in kept], list(node.units))


def _absorb(into: Node, other: Node) -> None:
    into.units += other.units
    for a, b in zip(into.children, other.children, strict=True):
        _absorb(a, b)


def analyse(page: str) -> tuple[str, list[Unit]]:
    """The page's shape and its texts, each with its node's number (in preorder) in the shape."""
    root, units = parse(page)
    form, merged = _shape(root)
    stack, n = [merged], 0
    while stack:
        node = stack.pop()
        for u in node.units:
            units[u].node = n
        n += 1
        stack += reversed(node.children)
    return form, units


def _read_shape(form: str) -> Node:
    root = Node("")
    stack = [root]
    for label, mark in re.findall(r"([^(),]*)([(),]?)", form):
        if label:
            stack[-1].children.append(Node(label))
        if mark == "(":
            stack.append(stack[-1].children[-1])
        elif mark == ")":
            stack.pop()
    return root.children[0]


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first, in which the second rises too."""
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(ends, j)
        before.append(last[at - 1] if at else -1)
        ends[at:], last[at:] = [j, *ends[at + 1 :]], [k, *last[at + 1 :]]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


class _Matching:
    """Simple tree matching: most pairs of nodes with equal labels, order and ancestry kept.

    Equal subtrees at both ends of two lists of children are paired at once, which costs no pairs. Lists that are still
    longer than CELLS allow are cut at the longest rising run of children that are equal and unique in both; between
    such cuts labels are paired in order where even that leaves too much."""

    def __init__(self, a: Node, b: Node):
        self.keys: list[dict[int, int]] = []
        self.sizes = [self._number(a), self._number(b)]
        self.known: dict[tuple[int, int], int] = {}

    def _number(self, root: Node) -> int:
        nodes, stack = [], [root]
        while stack:
            node = stack.pop()
            node.units = [len(nodes)]
            nodes.append(node)
            stack += reversed(node.children)
        keys: dict[int, int] = {}
        for node in reversed(nodes):
            keys[node.units[0]] = hash((node.label, *(keys[c.units[0]] for c in node.children)))
        self.keys.append(keys)
        return len(nodes)

    def weight(self, x: Node, y: Node) -> int:
        if x.label != y.label:
            return 0
        key = x.units[0], y.units[0]
        if key not in self.known:
            self.known[key] = 1 + sum(self.weight(x.children[i], y.children[j]) for i, j in self.pairs(x, y))
        return self.known[key]

    def pairs(self, x: Node, y: Node) -> list[tuple[int, int]]:
        cs, ds = x.children, y.children
        one, two = [self.keys[0][c.units[0]] for c in cs], [self.keys[1][d.units[0]] for d in ds]
        lo, n, m = 0, len(cs), len(ds)
        while lo < min(n, m) and one[lo] == two[lo]:
            lo += 1
        while min(n, m) > lo and one[n - 1] == two[m - 1]:
            n, m = n - 1, m - 1
        tail = [(n + k, m + k) for k in range(len(cs) - n)]
        return [(k, k) for k in range(lo)] + self._between(cs, ds, one, two, (lo, n), (lo, m)) + tail

    def _between(self, cs, ds, one, two, a: tuple[int, int], b: tuple[int, int]) -> list[tuple[int, int]]:
        (i, n), (j, m) = a, b
        if (n - i) * (m - j) <= CELLS:
            return self._table(cs, ds, a, b) if i < n and j < m else []
        seen = Counter(one[i:n]), Counter(two[j:m])
        place = {two[k]: k for k in range(j, m) if seen[1][two[k]] == 1}
        cuts = _longest_rising([(k, place[one[k]]) for k in range(i, n) if seen[0][one[k]] == 1 and one[k] in place])
        if not cuts:
            return self._in_order(cs, ds, a, b)
        out = []
        for p, q in [*cuts, (n, m)]:
            out += self._between(cs, ds, one, two, (i, p), (j, q))
            if p < n:
                out.append((p, q))
            i, j = p + 1, q + 1
        return out

    def _table(self, cs, ds, a: tuple[int, int], b: tuple[int, int]) -> list[tuple[int, int]]:
        (i0, n), (j0, m) = a, b
        rows = [[0] * (m - j0 + 1)]
        for i in range(i0, n):
            row = [0]
            for j in range(j0, m):
                row.append(max(row[-1], rows[-1][j - j0 + 1], rows[-1][j - j0] + self.weight(cs[i], ds[j])))
            rows.append(row)
        out, i, j = [], n, m
        while i > i0 and j > j0:
            w = self.weight(cs[i - 1], ds[j - 1])
            now = rows[i - i0][j - j0]
            if w and now == rows[i - i0 - 1][j - j0 - 1] + w:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif now == rows[i - i0 - 1][j - j0]:
                i -= 1
            else:
                j -= 1
        return out[::-1]

    @staticmethod
    def _in_order(cs, ds, a: tuple[int, int], b: tuple[int, int]) -> list[tuple[int, int]]:
        places: dict[str, list[int]] = {}
        for j in range(*b):
            places.setdefault(ds[j].label, []).append(j)
        out, at = [], b[0]
        for i in range(*a):
            own = places.get(cs[i].label, [])
            k = bisect.bisect_left(own, at)
            if k < len(own):
                out.append((i, own[k]))
                at = own[k] + 1
        return out


@functools.lru_cache(512)
def align(seed: str, form: str) -> tuple[int, ...]:
    """For each node of ``form``, the number of the node of ``seed`` that simple tree matching pairs it with, or -1."""
    a, b = _read_shape(seed), _read_shape(form)
    match = _Matching(a, b)
    out = [-1] * match.sizes[1]
    stack = [(a, b)] if a.label == b.label else []
    while stack:
        x, y = stack.pop()
        out[y.units[0]] = x.units[0]
        stack += [(x.children[i], y.children[j]) for i, j in match.pairs(x, y) if x.children[i].label == y.children[j].label]
    return tuple(out)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - 2**63


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            form, units = analyse(page.decode("utf-8", "replace"))
            slots = sorted({(u.node, _hash(u.text), u.article) for u in units if not u.dropped})
            rows.append((host, form, _hash(repr(slots)), [{"node": n, "hash": h, "article": a} for n, h, a in slots]))
        slot = pa.list_(pa.struct([("node", pa.int32()), ("hash", pa.int64()), ("article", pa.bool_())]))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), slot), strict=True)], names=["host", "form", "content", "slots"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = [list(align(s, f)) for s, f in zip(batch.column("seed").to_pylist(), batch.column("form").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maps, pa.list_(pa.int32()))], names=[*batch.schema.names, "aligned"])


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def induce(pages: DataFrame) -> DataFrame:
    """A wrapper per host of ``pages(url, html)``: host, seed (its tree) and template, the constant texts as an
    array of (node of the seed, text hash)."""
    rows = pages.select(host(pages["url"]).alias("host"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))
    outlines = rows.mapInArrow(_outlines, "host string, form string, content long, slots array<struct<node:int,hash:long,article:boolean>>")
    outlines = staged(outlines.filter("size(slots) > 0"), "outlines")
    # pages alike in every text count once: copies of an article do not make it a template
    distinct = outlines.groupBy("host", "form", "content").agg(F.first("slots").alias("slots"))
    forms = distinct.groupBy("host", "form").agg(F.count("*").alias("n"))
    seeds = staged(forms.groupBy("host").agg(F.max_by("form", F.struct("n", "form")).alias("seed"), F.sum("n").alias("pages")), "seeds")
    maps = forms.select("host", "form").join(seeds.select("host", "seed"), "host")
    maps = staged(maps.mapInArrow(_aligned, "host string, form string, seed string, aligned array<int>").select("host", "form", "aligned"), "maps")
    texts = distinct.select("host", "form", F.explode("slots").alias("s")).groupBy("host", "form", "s.node", "s.hash", "s.article").agg(F.count("*").alias("n"))
    texts = texts.join(maps, ["host", "form"]).withColumn("node", F.get("aligned", F.col("node"))).filter("node >= 0")
    texts = texts.groupBy("host", "node", "hash").agg(F.sum("n").alias("n"), F.max("article").alias("article")).join(seeds.select("host", "pages"), "host")
    enough = F.when(F.col("article"), (F.col("n") >= ARTICLE_PAGES) & (F.col("n") >= ARTICLE_SHARE * F.col("pages"))).otherwise(
        (F.col("n") >= TEMPLATE_PAGES) & (F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    )
    constant = texts.filter(enough).groupBy("host").agg(F.collect_list(F.struct("node", "hash")).alias("template"))
    return seeds.select("host", "seed").join(constant, "host", "left")


def main_text(page: str, seed: str | None, template: frozenset[tuple[int, int]]) -> str:
    """The page's content slots in page order, joined by one space."""
    form, units = analyse(page)
    to_seed = align(seed, form) if seed else ()
    marked = any(u.article and not u.dropped for u in units)
    slots = [u for u in units if not u.dropped and (u.article or not marked)]
    if not marked:
        slots = [u for u in slots if u.tag in PROSE or u.linked <= LINK_SHARE * len(u.text)]
    return " ".join(u.text for u in slots if not to_seed or (to_seed[u.node], _hash(u.text)) not in template)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, seed, template in zip(*(batch.column(c).to_pylist() for c in ("html", "seed", "template")), strict=True):
            constant = frozenset((t["node"], t["hash"]) for t in template or ())
            texts.append(main_text(page.decode("utf-8", "replace"), seed, constant))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages(page_id, url, html, ...)``.

    Null and empty html: empty text. A page without a readable host belongs to the host "". Broken markup is read as
    far as it goes: unclosed elements end with their parent, and text after the last tag counts. Repeated rows are
    extracted each; other columns are not read; an empty table gives an empty result.
    """
    wrappers = staged(induce(pages), "wrappers")
    size = wrappers.agg(F.sum(F.length("host") + F.length("seed") + 16 * F.coalesce(F.size("template"), F.lit(0)) + 64)).first()[0]
    if (size or 0) <= BROADCAST_BYTES:
        wrappers = F.broadcast(wrappers)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("host", host(F.col("url"))).join(wrappers, "host", "left").select("page_id", "url", "html", "seed", "template")
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
