"""Main text of web pages by wrapper induction (operator 6).

Pages of one host are made by one template. The DOM tree of every page, with like
siblings folded into one node, is reduced to its skeleton of tags and classes; the distinct skeletons of a
host are aligned by simple tree matching (the largest mapping that keeps tags, parents and the order of siblings)
and merged into one tree, the host's wrapper, which holds every node that some page has. Then every page is aligned
with its host's wrapper, and the texts at each node are counted over all pages of the host, in the cluster: a text
is constant if it stands at the same place (path of tags and classes) on at least two pages and on ``SHARE`` of them. A
node whose text is mostly constant is template; one whose text varies is a slot.

The content is the deepest node of the wrapper that holds ``MOST`` of the slots' text, but a heading that varies
beside that text belongs to it. Where several nested nodes hold it, an article or main element among
them breaks the tie. The main text of a page is what lies in its nodes under the content node, without template nodes, and
without constant texts of containers: a paragraph, heading, item or cell of a slot is running text, where authors
repeat themselves, and stays. In an article or main element only containers are cut whose text never varies, on
``SURE`` pages or more. Elements, roles, classes and ids that name menus, headers, footers, sidebars, notices, adverts,
forms, comments, scripts or styles take a part out before the alignment, since menus and adverts may vary, too.

Copies and near copies count once: pages whose longest text that isn't on most pages (``MOSTLY``) is the same are
one page. A page that is alone on its host, or has nothing under the content node, is judged by its own tree: its
largest article or main element with like siblings, else its body.

Null html is empty; null URLs and those without a host are one host; html may be cut off anywhere, elements left open
end with their parents. Elements nest to any depth, texts are of any length. Repeated rows are extracted each, ties
in page_id play no part. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.url_filter import split_url
from sylvan.runtime import discard, materialise, ship

#: Share of a host's pages that hold a constant text, at least; and that hold what can't tell pages apart.
SHARE, MOSTLY = 0.05, 0.5
#: Share of the slots' text that the content node holds, at least.
MOST = 0.7
#: Pages from which a container in an article whose text never varies is template.
SURE = 4
#: Wrappers are broadcast up to this many bytes in all, and joined beyond, each in so many copies, that no host is one task's.
BROADCAST_BYTES, COPIES = 16 << 20, 64
SCHEMA = "page_id long, url string, text string, n_chars long"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold main text.
NEVER = frozenset(
    "head script style title noscript template iframe object svg canvas nav aside footer form button select option textarea input label "
    "fieldset dialog menu audio video".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of classes and ids that mark what is no main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments comentarios "
    "consent cookie cookies disclaimer disqus dropdown footer foot gdpr header masthead menu menus modal nav navbar navigation newsletter notice "
    "notices notification outbrain overlay pager pagination popup promo promoted promotion related recommended replies reply respond rss "
    "share sharing sidebar sidebars sidenav signup skip social sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets".split()
)
#: Of these, words of the page's layout.
LAYOUT = frozenset("header masthead sidebar sidebars sidenav nav navbar navigation menu menus foot footer banner widget widgets topbar toolbar overlay modal".split())
#: Elements that end an open paragraph or item of the same kind, up to the element that holds it.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
PARAGRAPH = ({"p"}, {"td", "th", "table", "button"})
#: Elements of running text: like ones under one parent are one node of the wrapper.
FLOW = frozenset("p li dt dd tr td th h1 h2 h3 h4 h5 h6 blockquote pre hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that no browser shows.
UNSEEN = frozenset("head script style title noscript template iframe object svg canvas".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?![\w-])", re.IGNORECASE)


TEXT, OPEN, CLOSE, BREAK = range(4)


@dataclass(slots=True)
class Page:
    """Elements in page order (tag, attributes that count, parent), and what happens in that order: texts, the
    beginnings and ends of blocks, line breaks."""

    tags: list[str] = field(default_factory=lambda: ["html"])
    attrs: list[dict[str, str]] = field(default_factory=lambda: [{}])
    parent: list[int] = field(default_factory=lambda: [-1])
    stream: list[tuple[int, int, str]] = field(default_factory=list)


def attributes(source: str) -> dict[str, str]:
    if not source or source.isspace():
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def parse(source: str | None) -> Page:
    """A tolerant DOM: unknown, unclosed and stray tags are repaired as browsers commonly do."""
    page = Page()
    open_ = [0]
    where: dict[str, list[int]] = {}  # places in open_ by tag
    at, source = 0, source or ""

    def text(piece: str) -> None:
        if piece:
            page.stream.append((TEXT, open_[-1], html.unescape(piece)))

    def last(tags) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    def close(place: int) -> None:
        while len(open_) > place:
            node = open_.pop()
            where[page.tags[node]].pop()
            if page.tags[node] in BLOCK:
                page.stream.append((CLOSE, node, ""))

    while True:
        m = TOKEN.search(source, at)
        if m is None:
            rest = source[at:]
            cut = rest.rfind("<")  # a tag that the end of the page cuts off
            text(rest[:cut] if cut >= 0 and re.match(r"</?[a-zA-Z!?]?[^<>]*\Z", rest[cut:]) and (rest[cut + 1 : cut + 2].isalpha() or rest[cut + 1 : cut + 2] in ("/", "!", "?", "")) else rest)
            close(1)
            return page
        text(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in ("html", "body"):
            if not m[1]:
                page.attrs[0] |= attributes(m[3])
            continue
        if m[1]:
            place = last((tag,))
            if place and (tag in BLOCK or place > last(("article", "main", "table"))):
                close(place)
            continue
        for tags, within in ([PARAGRAPH] if tag in BLOCK else []) + ([ENDS[tag]] if tag in ENDS else []):
            place = last(tags)
            if place > last(within):
                close(place)
        node = len(page.tags)
        page.tags.append(tag)
        page.attrs.append(attributes(m[3]))
        page.parent.append(open_[-1])
        if tag == "br":
            page.stream.append((BREAK, node, ""))
        if tag in BLOCK:
            page.stream.append((OPEN, node, ""))
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            if tag in BLOCK:
                page.stream.append((CLOSE, node, ""))
            continue
        if tag in RAW:
            end = _raw_end(tag).search(source, at)
            page.stream.append((TEXT, node, source[at : end.start() if end else len(source)]))
            at = end.end() if end else len(source)
            continue
        where.setdefault(tag, []).append(len(open_))
        open_.append(node)


@lru_cache(maxsize=16)
def _raw_end(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE)


def words(value: str) -> set[str]:
    return set(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", value).lower()))


def is_main(tag: str, attrs: dict[str, str]) -> bool:
    return tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article") or attrs.get("itemprop") == "articleBody"


def is_boilerplate(tag: str, a: dict[str, str], holds: frozenset[str], inside: bool) -> bool:
    """By element, role, class or id. ``holds``: which of h1, main, article and headings the element holds;
    ``inside``: whether it lies in an article or main element."""
    if tag in NEVER:
        return True
    if tag == "header":
        return not (inside and holds & HEADINGS)
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.IGNORECASE):
        return True
    if a.get("role", "").lower() in ROLES:
        return True
    if tag == "main":
        return False
    marks = MARKS & (words(a.get("class", "")) | words(a.get("id", "")))
    # names such as "page with-sidebar" belong to containers of the main text itself
    return bool(marks) and not holds & ({"h1", "main", "article"} if marks <= LAYOUT else {"h1", "main"})


def dropped(page: Page, names: bool = True) -> list[bool]:
    """Which elements' own text is no main text by what the elements are, or lie in. A header in an article keeps
    its headings. Without ``names`` only what no browser shows."""
    n = len(page.tags)
    if not names:
        out = [False] * n
        for i in range(1, n):
            out[i] = out[page.parent[i]] or page.tags[i] in UNSEEN
        return out
    none: frozenset[str] = frozenset()
    holds = [none] * n
    for i in range(n - 1, 0, -1):
        own = holds[i] if page.tags[i] not in NEVER else none
        if page.tags[i] in HEADINGS or page.tags[i] in ("main", "article"):
            own = own | {page.tags[i]}
        if own - holds[page.parent[i]]:
            holds[page.parent[i]] = holds[page.parent[i]] | own
    gone, inside, header = [False] * n, [False] * n, [False] * n
    for i in range(n):
        up, tag, a = page.parent[i], page.tags[i], page.attrs[i]
        if i:
            gone[i] = gone[up] or is_boilerplate(tag, a, holds[i], inside[up])
            header[i] = (header[up] or tag == "header") and tag not in HEADINGS
        inside[i] = i > 0 and inside[up] or is_main(tag, a)
    return [g or h for g, h in zip(gone, header, strict=True)]


def like(tag: str, attrs: dict[str, str], names: bool = True) -> str:
    """What makes elements alike: tag and class, where numbers differ from page to page; ! marks an article or main element."""
    return f"{tag}{'!' if names and is_main(tag, attrs) else ''}.{re.sub(r'[0-9]+', '#', '-'.join(attrs.get('class', '').split()))}"


@dataclass(slots=True)
class Folded:
    """A page's block elements, like siblings folded into one node: depth and key of each in page order, and the
    page's texts in order, each with its node."""

    depth: list[int]
    keys: list[str]
    parent: list[int]
    texts: list[tuple[int, str]]

    def skeleton(self) -> str:
        return "\n".join(f"{d} {k}" for d, k in zip(self.depth, self.keys, strict=True))


def fold(page: Page, names: bool = True) -> Folded:
    """Blocks that are dropped, and all inline elements, are no nodes."""
    gone = dropped(page, names)
    block = [0] * len(page.tags)  # the nearest block, itself included
    below: dict[int, list[int]] = {0: []}
    for i in range(1, len(page.tags)):
        up = block[page.parent[i]]
        block[i] = up
        # a header's headings are nodes although the header itself is dropped
        if page.tags[i] in BLOCK and not gone[i]:
            block[i] = i
            below.setdefault(up, []).append(i)
    out, of = Folded([], [], [], []), {}
    stack: list[tuple[int, int, str, list[int]]] = [(-1, 0, "html.", [0])]
    while stack:
        up, depth, key, nodes = stack.pop()
        me = len(out.keys)
        out.depth.append(depth)
        out.keys.append(key)
        out.parent.append(up)
        of.update(dict.fromkeys(nodes, me))
        groups: list[tuple[str, list[int]]] = []
        flow: dict[str, list[int]] = {}
        for c in (c for x in nodes for c in below.get(x, ())):
            k = like(page.tags[c], page.attrs[c], names)
            if page.tags[c] in FLOW and k in flow:
                flow[k].append(c)
            elif groups and groups[-1][0] == k and not k.endswith("."):
                groups[-1][1].append(c)
            else:
                groups.append((k, [c]))
                if page.tags[c] in FLOW:
                    flow[k] = groups[-1][1]
        stack += [(me, depth + 1, k, list(g)) for k, g in reversed(groups)]
    run: list[str] = []
    at = 0

    def flush() -> None:
        if t := " ".join("".join(run).split()):
            out.texts.append((of[block[at]], t))
        run.clear()

    for kind, node, piece in page.stream:
        if kind == TEXT:
            if not gone[node]:
                if block[node] != at:
                    flush()
                    at = block[node]
                run.append(piece)
        elif kind == BREAK:
            run.append(" ")
        else:
            flush()
    flush()
    return out


# ---- trees and their alignment


@dataclass(slots=True)
class Tree:
    """A skeleton in page order: keys, children, sizes of subtrees, and a number for each shape."""

    keys: list[str]
    below: list[list[int]]
    size: list[int]
    shape: list[int]


def tree(skeleton: str, shapes: dict) -> Tree:
    """``shapes`` numbers the subtrees: equal numbers, equal subtrees."""
    keys, below, line = [], [], []
    for i, row in enumerate(skeleton.split("\n")):
        depth, _, key = row.partition(" ")
        del line[int(depth) :]
        if line:
            below[line[-1]].append(i)
        line.append(i)
        keys.append(key)
        below.append([])
    size, shape = [1] * len(keys), [0] * len(keys)
    for i in range(len(keys) - 1, -1, -1):
        size[i] = 1 + sum([size[c] for c in below[i]])
        shape[i] = shapes.setdefault((keys[i], tuple([shape[c] for c in below[i]])), len(shapes))
    return Tree(keys, below, size, shape)


def match(a: Tree, b: Tree) -> list[int]:
    """Simple tree matching: for each node of ``a`` its node of ``b``, or -1."""
    known: dict[tuple[int, int], int] = {}
    to = [-1] * len(a.keys)

    def weight(x: int, y: int) -> int:
        """Nodes that match in the trees below x and y, themselves included; 0 if these differ."""
        if a.shape[x] == b.shape[y]:
            return a.size[x]
        if a.keys[x] != b.keys[y]:
            return 0
        pair = (a.shape[x], b.shape[y])
        if pair not in known:
            _, _, table = rows(a.below[x], b.below[y])
            known[pair] = 1 + table
        return known[pair]

    def rows(xs: list[int], ys: list[int]) -> tuple[int, list[list[int]], int]:
        """Equal trees at the start, the table of best sums for what lies between, and the best sum of all."""
        head = 0
        while head < min(len(xs), len(ys)) and a.shape[xs[head]] == b.shape[ys[head]]:
            head += 1
        tail = 0
        while tail < min(len(xs), len(ys)) - head and a.shape[xs[-1 - tail]] == b.shape[ys[-1 - tail]]:
            tail += 1
        best = [[0] * (len(ys) - head - tail + 1)]
        for x in xs[head : len(xs) - tail]:
            above, row = best[-1], [0]
            for j, y in enumerate(ys[head : len(ys) - tail]):
                w = weight(x, y)
                row.append(max(above[j + 1], row[j], above[j] + w if w else 0))
            best.append(row)
        total = best[-1][-1]
        for x in xs[:head]:
            total += a.size[x]
        for x in xs[len(xs) - tail :]:
            total += a.size[x]
        return head, best, total

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 1000 + 4 * (len(a.keys) + len(b.keys))))  # trees are as deep as the pages
    try:
        stack = [(0, 0)] if a.keys[0] == b.keys[0] else []
        while stack:
            x, y = stack.pop()
            if a.shape[x] == b.shape[y]:
                for i in range(a.size[x]):
                    to[x + i] = y + i
                continue
            to[x] = y
            xs, ys = a.below[x], b.below[y]
            head, best, _ = rows(xs, ys)
            stack += zip(xs[:head], ys[:head], strict=True)
            i, j = len(best) - 1, len(best[0]) - 1
            stack += zip(xs[head + i :], ys[head + j :], strict=True)
            while i and j:
                w = weight(xs[head + i - 1], ys[head + j - 1])
                if w and best[i][j] == best[i - 1][j - 1] + w:
                    i, j = i - 1, j - 1
                    stack.append((xs[head + i], ys[head + j]))
                elif best[i][j] == best[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
    finally:
        sys.setrecursionlimit(limit)
    return to


def merge(wrapper: str, skeleton: str) -> str:
    """The wrapper with those nodes of the skeleton besides that it lacks, each after the sibling it follows."""
    shapes: dict = {}
    w, s = tree(wrapper, shapes), tree(skeleton, shapes)
    to = match(s, w)
    if -1 not in to:
        return wrapper
    own: list[list[tuple[Tree, int]]] = [[(w, c) for c in cs] for cs in w.below]
    for x, y in enumerate(to):
        if y < 0:
            continue
        at = 0
        for c in s.below[x]:
            if to[c] >= 0:
                at = own[y].index((w, to[c])) + 1
            else:
                own[y].insert(at, (s, c))
                at += 1
    out: list[str] = []
    stack = [(w, 0, 0)]
    while stack:
        t, i, depth = stack.pop()
        out.append(f"{depth} {t.keys[i]}")
        stack += [(u, c, depth + 1) for u, c in reversed(own[i] if t is w else [(s, c) for c in s.below[i]])]
    return "\n".join(out)


def induce(skeletons: list[str]) -> str:
    """The wrapper of a host's skeletons: the largest first, the others merged into it."""
    first, *rest = sorted(set(skeletons), key=lambda x: (-x.count("\n"), x))
    for skeleton in rest:
        first = merge(first, skeleton)
    return first


@lru_cache(maxsize=2048)
def aligned(skeleton: str, wrapper: str) -> list[int]:
    """For each node of a page its node of the wrapper, or -1. Pages of one skeleton are aligned once."""
    shapes: dict = {}
    return match(tree(skeleton, shapes), tree(wrapper, shapes))


# ---- content


@lru_cache(maxsize=512)
def content(wrapper: str, counts: str) -> tuple[list[bool], list[bool], list[bool]] | None:
    """For each node of the wrapper whether it lies in the content, in an article or main element of it, and whether it
    is template. ``counts``: pages of the host, then node:varying:constant characters; None if nothing varies."""
    t = tree(wrapper, {})
    kinds, *rows = counts.split(" ")
    n = len(t.keys)
    varying, constant = [0] * n, [0] * n
    for row in rows:
        i, v, c = map(int, row.split(":"))
        varying[i], constant[i] = v, c
    up = [-1] * n
    for i in range(n):
        for c in t.below[i]:
            up[c] = i
    template = [c > v for v, c in zip(varying, constant, strict=True)]
    volume = [0 if x else v for x, v in zip(template, varying, strict=True)]
    main = ["!" in k.partition(".")[0] for k in t.keys]
    flow = [k.partition(".")[0].rstrip("!") in FLOW for k in t.keys]
    heading = [k.partition(".")[0] in HEADINGS and v > 0 for k, v in zip(t.keys, volume, strict=True)]
    for i in range(n - 1, 0, -1):
        volume[up[i]] += volume[i]
        heading[up[i]] |= heading[i]
    if not volume[0]:
        return None
    line = [0]
    while t.below[line[-1]]:
        best = max(t.below[line[-1]], key=lambda c: (volume[c], -c))
        beside = any([heading[c] for c in t.below[line[-1]] if c != best])
        if flow[best] or volume[best] < MOST * volume[0] or beside and not any([main[i] for i in range(best, best + t.size[best])]):
            break
        line.append(best)
    chosen = [i for i in line if main[i]][-1:]
    if not chosen:
        inner = [i for i in range(line[-1], line[-1] + t.size[line[-1]]) if main[i]]
        outer, end = [], 0
        for i in inner:
            if i >= end:
                outer.append(i)
                end = i + t.size[i]
        chosen = outer if sum([volume[i] for i in outer]) >= MOST * volume[0] else line[-1:]
    inside, in_main = [False] * n, [False] * n
    for i in chosen:
        for j in range(i, i + t.size[i]):
            inside[j] = True
    for i in range(n):
        in_main[i] = main[i] or up[i] >= 0 and in_main[up[i]]
        if in_main[i] and template[i]:
            template[i] = not varying[i] and not flow[i] and int(kinds) >= SURE
    return inside, in_main, template


def own_content(page: Folded) -> list[str]:
    """The texts of the content by the page alone: of its largest article or main element, else of its body."""
    n = len(page.keys)
    size = [0] * n
    for node, text in page.texts:
        size[node] += len(text)
    holds = ["!" in k.partition(".")[0] for k in page.keys]
    main = list(holds)
    for i in range(n - 1, 0, -1):
        size[page.parent[i]] += size[i]
        if holds[i]:
            holds[page.parent[i]] = True
            main[page.parent[i]] = False  # an article in a main element is the closer one
    best = max((i for i in range(n) if main[i]), key=lambda i: (size[i], -i), default=0)
    inside = [False] * n
    for i in range(n):  # its like siblings are parts of it
        part = main[i] and page.keys[i] == page.keys[best] and page.parent[i] == page.parent[best]
        inside[i] = i == best or part or i > 0 and inside[page.parent[i]]
    return [text for node, text in page.texts if inside[node]]


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def places(page: Folded) -> list[int]:
    """For each of the page's texts a number for its place (the path of keys) and itself."""
    path = []
    for i, key in enumerate(page.keys):
        path.append(digest(f"{path[page.parent[i]] if i else ''}/{key}"))
    return [digest(f"{path[node]} {text}") for node, text in page.texts]


@lru_cache(maxsize=512)
def numbers(constants: str) -> frozenset[int]:
    return frozenset(map(int, constants.split())) if constants else frozenset()


def extract(source: str | None, wrapper: str | None = None, counts: str | None = None, constants: str | None = None, names: bool = True) -> str:
    """Main text of a page: its blocks, two newlines between. ``wrapper``, ``counts`` and ``constants`` of its host
    as :func:`hosts` has them; without them, or where they leave nothing, the page's own tree decides."""
    if not source:
        return ""
    page = fold(parse(source), names)
    known = content(wrapper, counts) if wrapper and counts else None
    if known is not None:
        inside, in_main, template = known
        to = list(aligned(page.skeleton(), wrapper))
        fixed = numbers(constants or "")
        lone = [False] * len(to)
        for i, w in enumerate(to):
            if w < 0:  # what the wrapper lacks belongs to what holds it
                to[i], lone[i] = (to[page.parent[i]] if i else 0), True
        found = []
        for (node, text), place in zip(page.texts, places(page), strict=True):
            w = to[node]
            running = in_main[w] or page.keys[node].partition(".")[0] in FLOW
            if inside[w] and (lone[node] or not template[w]) and (running or place not in fixed):
                found.append(text)
        if found:
            return "\n\n".join(found)
    return "\n\n".join(own_content(page))


def hosts(rows: DataFrame, share: float = SHARE, names: bool = True) -> DataFrame:
    """host, ``wrapper``, ``counts`` (see :func:`content`) and ``constants`` (see :func:`places`) of each host of two
    different pages or more. ``rows``: host, html, and h, a hash of the html."""
    rows = rows.where("html is not null")

    def skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fold(parse(x), names).skeleton() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["host", "skeleton"])

    def induced(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "skeleton": [induce(list(frame["skeleton"]))]})

    distinct = rows.select("host", "html").mapInArrow(skeletons, "host string, skeleton string").distinct()
    parts = materialise(distinct.withColumn("part", F.pmod(F.xxhash64("skeleton"), F.lit(COPIES))), "html-skeletons")
    some = parts.groupBy("host", "part").applyInPandas(induced, "host string, skeleton string")  # parts of a host first
    wrappers = materialise(some.groupBy("host").applyInPandas(induced, "host string, skeleton string").toDF("host", "wrapper"), "html-wrappers")

    def seen_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, h, source, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = fold(parse(source), names)
                to = aligned(page.skeleton(), wrapper)
                out += {(host, h, to[node], place, len(text)) for (node, text), place in zip(page.texts, places(page), strict=True)}
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["host", "h", "node", "t", "size"])

    met = with_hosts(rows.select("host", "h", "html"), wrappers).select("host", "h", "html", "wrapper")
    seen = materialise(met.mapInArrow(seen_texts, "host string, h long, node long, t long, size long").distinct(), "html-seen")
    pages = seen.groupBy("host").agg(F.countDistinct("h").alias("pages"))
    # what a page is told apart by: its longest text that is not on most pages, else its longest
    held = seen.groupBy("host", "t").agg(F.countDistinct("h").alias("held")).join(pages, "host")
    held = held.select("host", "t", (F.col("held") > F.greatest(F.lit(1.0), F.col("pages") * MOSTLY)).alias("mostly"))
    known = seen.join(held, ["host", "t"]).groupBy("host", "h").agg(F.max(F.struct(~F.col("mostly"), "size", "t"))["t"].alias("mark"))
    known = materialise(known, "html-marks")
    kinds = known.groupBy("host").agg(F.countDistinct("mark").alias("kinds")).where("kinds > 1")
    marked = seen.join(known, ["host", "h"])
    often = marked.groupBy("host", "t").agg(F.countDistinct("mark").alias("n")).join(kinds, "host")
    often = often.select("host", "t", "kinds", (F.col("n") >= F.greatest(F.lit(2.0), F.col("kinds") * share)).alias("fixed"))
    often = materialise(often, "html-often")
    volume = marked.groupBy("host", "node", "t").agg((F.countDistinct("mark") * F.max("size")).alias("v")).join(often, ["host", "t"])
    part = lambda fixed: F.sum(F.when(F.col("fixed") == fixed, F.col("v")).otherwise(0))
    nodes = volume.where("node >= 0").groupBy("host", "node", "kinds").agg(F.concat_ws(":", F.col("node"), part(False), part(True)).alias("row"))
    counts = nodes.groupBy("host").agg(F.concat_ws(" ", F.max("kinds"), F.array_sort(F.collect_list("row"))).alias("counts"))
    fixed = often.where("fixed").groupBy("host").agg(F.array_join(F.array_sort(F.collect_list("t")).cast("array<string>"), " ").alias("constants"))
    out = materialise(wrappers.join(counts, "host").join(fixed, "host", "left"), "html-hosts")
    discard(parts, wrappers, seen, known, often)
    return out


def with_hosts(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows with what is known of their host, by broadcast if it is small, else in copies among which a host's rows are dealt."""
    size = known.agg(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in known.columns), F.lit(0)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(known), "host", "left")
    copies = known.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return rows.withColumn("copy", F.pmod(F.xxhash64("h"), F.lit(COPIES)).cast("int")).join(copies, ["host", "copy"], "left").drop("copy")


def extract_pages(pages: DataFrame, names: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    ship(pages.sparkSession)
    host, _ = split_url(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.select("*", host.alias("host"), F.xxhash64("html").alias("h"))
    met = with_hosts(rows, hosts(rows, names=names)).select("page_id", "url", "html", "wrapper", "counts", "constants")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(*x, names) for x in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return met.mapInArrow(run, SCHEMA)
