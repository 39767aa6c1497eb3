"""Main text of HTML pages by wrapper induction.

A page becomes a tree of its block elements.  A few pages of each host, and of each of
its layouts, serve as references; every page is aligned with those of its host and of
its layout by simple tree matching (the largest order-preserving match of children,
level by level).  Reference nodes whose text most pages of the host, or of the layout,
repeat at the aligned place are template; the other slots vary.  The text that the pages
have in each slot is added up, and the content is the innermost container that holds
most of the varying text outside links: what varies beside it (adverts, link lists,
notices) is left out whatever it is called.

Where no container stands out, and for hosts with too few pages to align, articles are
found by element and class name.  Menus, forms, comments and the like inside the content
go by element name or by whole class names; never the page's body, and no element that
holds most of the page's text.

A page meets only the references of its host and layout.  A host with many pages is
dealt to several tasks, each with a copy of the references; counts are summed before
they are shuffled.
"""

from __future__ import annotations

import functools
import html as entities
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import materialise, read

REFERENCES = 2
#: A slot is template if at least this many pages, and this share of the host's or of the layout's, repeat it
LEAST_PAGES, SHARE = 4, 0.6
#: Cells of an alignment table; longer lists of children are aligned by halves, with the same result
CELLS = 40_000
#: Share of a container's varying text that a container inside it must hold to be the content
MAIN_SHARE = 0.7
#: Larger references and wrappers are joined; a host is then dealt to one task for each 256th of the pages
BROADCAST_BYTES, DEALS = 8 << 20, 256

# Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li legend main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"body", "html", "head", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: an element that ends an open one of the second set, up to the third
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
_DROPPED = frozenset("head nav aside footer form fieldset select option button menu dialog script style noscript template iframe svg math canvas object audio video textarea title".split())
#: words that mark what is not the article: a class, id or role of such words only, besides neutral ones
_DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer foot sidebar sidenav aside rail widget widgets "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist discussion disqus replies reply respond reactions feedback "
    "search searchbox pagination pager skip toc copyright legal toolbar contentinfo complementary".split()
)
_NEUTRAL_NAMES = frozenset("site page top bottom left right upper lower main list area box bar slot unit block wrap wrapper container section inner outer global primary secondary button buttons link links post posts item items group row col column thread form header footer".split())
#: of these a page may hold more than of the article
_COMMENT_NAMES = frozenset("comment comments commentlist discussion disqus replies reply respond reactions".split())
_ARTICLE_NAMES = frozenset("article main articlebody".split())
_CONTAINERS = frozenset("#root html body div section article main center table tbody tr td".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_WORDS = re.compile(r"[a-z]+|[0-9]+")
#: an opening tag of a block element up to its class, in either case
_OPENED = "(?i)<(?:" + "|".join(sorted(_BLOCK, key=lambda x: (-len(x), x))) + r""")(?=[\s/>])(?:[^>]{0,200}?\bclass\s*=\s*(?:"[^">]*"|'[^'>]*'|[^\s"'>]+))?"""
_TAG = re.compile(r"""([^<]*+)<(/?)([A-Za-z][^\s/>\x00]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""(?:^|\s|/)(class|id|role|hidden|style|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
_DROPPED_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _DROPPED}
_P, _ENDS_P = frozenset({"p"}), frozenset({"td", "th", "div", "article", "section", "li", "blockquote"})


def _attributes(said: str) -> str:
    """Names of classes, id and role, lower-cased, with ``hidden`` for what is not shown."""
    out = []
    for name, value in _ATTRIBUTE.findall(said):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            out.append("!hidden")
        elif name != "style":
            out.append(value)
    return " ".join(out)


#: for short attributes, which elements made alike share
_short_attributes = functools.lru_cache(4096)(_attributes)


def parse(source: str) -> tuple[list[str], list[str], list[int], list[list[str] | None], list[int]]:
    """A tree of block elements; inline markup dissolves into the text around it.

    Columns in page order, from a root: tag, class names, the parent's position, pieces of
    text (None but for text nodes), and characters of a text node that stand in links.
    Never fails: unknown markup counts as inline, unclosed elements end with their
    parent, and an unclosed comment, script or tag reaches to the end.
    """
    tags, named, parents, pieces, linked = ["#root"], [""], [-1], [None], [0]
    node = 0
    text = -1  # the text node that is open, if any
    at, n = 0, len(source)
    open_tags: dict[str, int] = defaultdict(int)
    in_link = False
    match, unescape = _TAG.match, entities.unescape

    def add(tag: str, names: str, parts: list[str] | None) -> int:
        tags.append(tag)
        named.append(names)
        parents.append(node)
        pieces.append(parts)
        linked.append(0)
        return len(tags) - 1

    def say(piece: str) -> None:
        nonlocal text
        if text < 0:
            if piece.isspace():
                return
            text = add("#text", "", [])
        pieces[text].append(unescape(piece) if "&" in piece else piece)
        if in_link:
            linked[text] += len(piece)

    def close(upto: int) -> None:
        """Leave ``upto`` and all that is open inside it."""
        nonlocal node, text
        while node != upto:
            open_tags[tags[node]] -= 1
            node = parents[node]
        open_tags[tags[upto]] -= 1
        node, text = parents[upto], -1

    def opened(names, stop) -> int:
        """The innermost open element of those names that no ``stop`` is open in, or 0."""
        if not any(open_tags[t] for t in names):
            return 0
        x = node
        while x and tags[x] not in stop:
            if tags[x] in names:
                return x
            x = parents[x]
        return 0

    while at < n:
        m = match(source, at)
        if not m:
            lt = source.find("<", at)
            if lt != at:
                say(source[at:lt] if lt >= 0 else source[at:])
            if lt < 0:
                break
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif re.match(r"<[!?/A-Za-z]", source[lt : lt + 2]):  # with a letter: an unclosed tag or quote
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                say("<")
                at = lt + 1
            continue
        piece, closing, tag, said = m.groups()
        at = m.end()
        if piece:
            say(piece)
        tag = tag.lower()
        if closing:
            if tag in _BLOCK:
                own = node if tags[node] == tag else opened((tag,), ())
                if own:
                    close(own)
                text, in_link = -1, False
            elif tag == "a":
                in_link = False
            continue
        if tag not in _BLOCK:
            if tag in _RAW:
                if not said.endswith("/") or tag in ("script", "style"):
                    end = _RAW_END[tag].search(source, at)
                    stop = source.find(">", end.end()) if end else -1
                    at = n if not end or stop < 0 else stop + 1
            elif tag == "br":
                if text >= 0:
                    say(" ")
            elif tag == "a":
                in_link = True
            elif tag in _DROPPED:  # inline elements that are never article text, such as buttons
                end = _DROPPED_END[tag].search(source, at)
                at = end.end() if end else at
            continue
        if open_tags["p"] and tag in _CLOSES_P and (p := opened(_P, _ENDS_P)):
            close(p)
        if tag in _ENDS:
            names, stop = _ENDS[tag]
            while own := opened(names, stop):
                close(own)
        text, in_link = -1, False
        if tag == "hr":
            continue
        node = add(tag, "" if not said else _short_attributes(said) if len(said) <= 200 else _attributes(said), None)
        open_tags[tag] += 1
    return tags, named, parents, pieces, linked


def _named(names: str) -> frozenset[str]:
    """Telling words of those class names, ids and roles that consist of such words and neutral ones."""
    out = set()
    for name in names.split():
        words = [w for w in _WORDS.findall(name)]
        known = _DROPPED_NAMES.intersection(words)
        if known and all(w in known or w in _NEUTRAL_NAMES or w.isdigit() for w in words):
            out |= known
    return frozenset(out)


_named = functools.lru_cache(4096)(_named)


@functools.lru_cache(4096)
def _is_dropped(tag: str, names: str, inside: bool, large: bool = False) -> bool:
    """Whether a node is no part of the article; ``inside``: within one; ``large``: it holds most of the page's text."""
    if tag in _DROPPED or tag == "header" and not inside:
        return True
    if not names or tag in ("html", "body", "main"):
        return False
    if "!hidden" in names:
        return True
    said = _named(names) - ({"header"} if inside else set())
    if not said or not _ARTICLE_NAMES.isdisjoint(names.split()):
        return False
    return not said.isdisjoint(_COMMENT_NAMES) or not large and tag != "article"


def _is_article(tag: str, names: str) -> bool:
    return tag in ("article", "main") or bool(names) and any(w in ("main", "article", "articlebody") for w in names.split())


class Page:
    """The nodes of a page in page order, and what of them is no part of an article."""

    def __init__(self, source: str):
        self.tags, self.names, self.parent, pieces, linked = parse(source)
        n = len(self.tags)
        self.said = [" ".join("".join(x).split()) if x else "" for x in pieces]
        #: characters below each node outside links, where no element name tells against it
        self.plain = [max(0, len(t) - k) if t else 0 for t, k in zip(self.said, linked)]
        shut, self.mass = [False] * n, self.plain.copy()
        self.inside, self.gone, self.dropped = ([False] * n for _ in range(3))
        for i, (tag, up) in enumerate(zip(self.tags, self.parent)):
            if i and shut[up] or tag in _DROPPED:
                shut[i], self.mass[i] = True, 0
        for i in range(n - 1, 0, -1):  # children follow their parent
            self.mass[self.parent[i]] += self.mass[i]
        inside, gone, dropped, half = self.inside, self.gone, self.dropped, self.mass[0] / 2
        for i, (tag, names, up) in enumerate(zip(self.tags, self.names, self.parent)):
            if tag == "#text":
                dropped[i] = dropped[up]
            elif i:
                gone[i] = _is_dropped(tag, names, inside[up], self.mass[i] > half)
                dropped[i] = gone[i] or dropped[up]
                inside[i] = inside[up] or not gone[i] and _is_article(tag, names)

    def large(self, i: int) -> bool:
        return 2 * self.mass[i] > self.mass[0]

    def below(self, top: int) -> range:
        """Positions of ``top`` and all nodes inside it."""
        end = top + 1
        while end < len(self.tags) and self.parent[end] >= top:
            end += 1
        return range(top, end)

    def rows(self) -> list[list]:
        """(parent, label, text hash) in page order; the hash is 0 without text."""
        return [
            [p, f"{tag}.{names}", (zlib.crc32(t.encode(errors="replace")) or 1) if t else 0]
            for p, tag, names, t in zip(self.parent, self.tags, self.names, self.said)
        ]


# --- references and alignment -------------------------------------------------------


def outline(source: str) -> list[list]:
    """A page as rows (parent, label, text hash) in page order."""
    return Page(source).rows()


def _pack(rows: list[list]) -> str:
    return "\n".join(f"{p}\t{re.sub(r'[\t\n]', ' ', label)}\t{h}" for p, label, h in rows)


class Outline:
    def __init__(self, rows: list[list]):
        self.label = [re.sub(r"[\t\n]", " ", r[1]) if "\t" in r[1] or "\n" in r[1] else r[1] for r in rows]
        self.hash = [int(r[2]) for r in rows]
        self.children: list[list[int]] = [[] for _ in rows]
        for i, r in enumerate(rows):
            if (parent := int(r[0])) >= 0:
                self.children[parent].append(i)
        # a node that is a leaf, or has a leaf as its only child: its shape, size and text
        self.shape: list[str | None] = []
        self.size = [1] * len(rows)
        self.inner = list(self.hash)
        for i, below in enumerate(self.children):
            if not below:
                self.shape.append(self.label[i])
            elif len(below) == 1 and not self.children[below[0]]:
                self.shape.append(f"{self.label[i]}>{self.label[below[0]]}")
                self.size[i], self.inner[i] = 2, self.hash[below[0]]
            else:
                self.shape.append(None)
        self._forms: list[int] | None = None
        self._columns: dict[int, list[tuple]] = {}

    @functools.cached_property
    def known(self) -> frozenset[int]:
        """Hashes of all its texts."""
        return frozenset(self.hash) - {0}

    def columns(self, i: int) -> list[tuple]:
        """Of each child of a node: its position, label, shape, text and size."""
        if i not in self._columns:
            self._columns[i] = [(c, self.label[c], self.shape[c], self.inner[c], self.size[c]) for c in self.children[i]]
        return self._columns[i]

    @property
    def forms(self) -> list[int]:
        """Of each node, a hash of the labels of its subtree."""
        if self._forms is None:
            self._forms = [0] * len(self.label)
            for i in reversed(range(len(self.label))):  # children follow their parent
                self._forms[i] = hash((self.label[i], *(self._forms[c] for c in self.children[i])))
        return self._forms

    def texts(self, top: int) -> set[int]:
        """Hashes of the texts below a node."""
        out, todo = set(), [top]
        while todo:
            i = todo.pop()
            if self.hash[i]:
                out.add(self.hash[i])
            todo += self.children[i]
        return out


@functools.lru_cache(256)
def _outline(packed: str) -> Outline:
    return Outline([line.split("\t") for line in packed.split("\n")] if packed else [])


def align(page: Outline, other: Outline) -> dict[int, int]:
    """Nodes of ``page`` matched to nodes of ``other`` by simple tree matching.

    Roots match if their labels do; then children are matched in order, so that the
    matched subtrees have as many nodes as possible.  Equal texts count a half more.
    """
    # a level takes six frames at most; frames of Python functions do not use the C stack
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 6 * min(len(page.label), len(other.label)) + 2000))
    weight: dict[tuple[int, int], float] = {}
    back: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def value(a: int, b: int) -> float:
        if page.label[a] != other.label[b]:
            return 0.0
        if (a, b) in weight:
            return weight[a, b]
        xs, ys = page.children[a], other.children[b]
        own = 1.0 + (0.5 if page.hash[a] and page.hash[a] == other.hash[b] else 0.0)
        if len(xs) * len(ys) > CELLS:
            pairs = _halved(page, other, xs, ys, value)
            total = 0.0
            for x, y in pairs:
                total += value(x, y)
        elif total := _in_step(page, other, a, b):
            pairs = list(zip(xs, ys))
        else:
            table = [[0.0] * (len(ys) + 1)]
            columns = other.columns(b)
            for x, label, shape, text, size in page.columns(a):
                above, row, left = table[-1], [0.0], 0.0
                for j, (y, label_y, shape_y, text_y, _) in enumerate(columns):
                    up = above[j + 1]
                    if up > left:
                        left = up
                    if label == label_y:
                        if shape is not None and shape == shape_y:
                            v = above[j] + (size + 0.5 if text and text == text_y else size)
                        else:
                            v = above[j] + value(x, y)
                        if v > left:
                            left = v
                    row.append(left)
                table.append(row)
            total, pairs, i, j = table[-1][-1], [], len(xs), len(ys)
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((xs[i], ys[j]))
        weight[a, b], back[a, b] = own + total, pairs
        return own + total

    out: dict[int, int] = {}
    if page.label and other.label and value(0, 0):
        todo = [(0, 0)]
        while todo:
            a, b = todo.pop()
            out[a] = b
            value(a, b)
            for x, y in back[a, b]:
                if page.label[x] != other.label[y]:
                    continue
                if page.shape[x] is not None and page.shape[x] == other.shape[y]:
                    out[x] = y
                    out.update(zip(page.children[x], other.children[y]))  # their only children, if any
                else:
                    todo.append((x, y))
    return out


def _in_step(page: Outline, other: Outline, a: int, b: int) -> float:
    """What the children of a pair are worth if they match one by one from the first; 0 unless no matching is worth as much.

    So it is where the shorter list is alike the start of the longer one in shape, and
    each of its texts occurs at its own place or nowhere in the other page: then none of
    its nodes can be worth more elsewhere, and an alignment table would choose the same pairs.
    """
    xs, ys = page.columns(a), other.columns(b)
    x_leads = len(xs) <= len(ys)
    known = other.known if x_leads else page.known
    total = 0.0
    for (_, label, shape, text, size), (_, label_y, shape_y, text_y, _) in zip(xs, ys):
        if shape is None or shape != shape_y or label != label_y:
            return 0.0
        if text and text == text_y:
            total += size + 0.5
        elif (text if x_leads else text_y) in known:
            return 0.0
        else:
            total += size
    return total


def _halved(page: Outline, other: Outline, xs: list[int], ys: list[int], value) -> list[tuple[int, int]]:
    """The largest ordered matching of two long lists, in memory that grows with their length.

    The value of a pair without a common text depends on both forms only, so it is
    computed once; a row of the table is then a running maximum.  The first list is
    halved, and the second where the best values of both halves add up to the most.
    """
    kinds = {f: k for k, f in enumerate(dict.fromkeys(other.forms[y] for y in ys))}
    kind = np.array([kinds[other.forms[y]] for y in ys])
    common: dict[int, list[int]] = {}
    for j, y in enumerate(ys):
        for h in other.texts(y):
            common.setdefault(h, []).append(j)
    members = [np.flatnonzero(kind == k) for k in range(len(kinds))]
    sharing = [np.array(sorted({j for h in page.texts(x) for j in common.get(h, ())}), dtype=np.int64) for x in xs]
    plain: dict[tuple[int, int], float] = {}

    def values(i: int) -> np.ndarray:
        x, mine = xs[i], sharing[i]
        apart = np.ones(len(ys), dtype=bool)
        apart[mine] = False
        of_kind = np.zeros(len(kinds))
        for k, places in enumerate(members):
            if (page.forms[x], k) not in plain:
                free = places[apart[places]]
                if not len(free):
                    continue
                plain[page.forms[x], k] = value(x, ys[free[0]])
            of_kind[k] = plain[page.forms[x], k]
        out = of_kind[kind]
        known: dict[tuple[int, int], float] = {}
        for j in mine.tolist():
            y = ys[j]
            if other.shape[y] is not None:
                key = (kind[j], other.inner[y])
                if key not in known:
                    known[key] = value(x, y)
                out[j] = known[key]
            else:
                out[j] = value(x, y)
        return out

    def best(rows, lo: int, hi: int, back: bool) -> np.ndarray:
        """Most that ``rows`` reach with each number of places from ``lo``, or back from ``hi``."""
        row = np.zeros(hi - lo + 1)
        for i in rows:
            v = values(i)[lo:hi]
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (v[::-1] if back else v)))
        return row

    out, todo = [], [(0, len(xs), 0, len(ys))]
    while todo:
        a, b, lo, hi = todo.pop()
        if a == b or lo == hi:
            continue
        if b - a == 1:
            v = values(a)[lo:hi]
            if v.max() > 0:
                out.append((xs[a], ys[lo + int(v.argmax())]))
            continue
        mid = (a + b) // 2
        total = best(range(a, mid), lo, hi, False) + best(range(b - 1, mid - 1, -1), lo, hi, True)[::-1]
        cut = lo + int(total.argmax())
        todo += [(mid, b, cut, hi), (a, mid, lo, cut)]
    return out


def _main_slot(other: Outline, template: set[int], mass: dict[int, float]) -> int:
    """The innermost container that holds most of the varying text, or -1 if none below the body does.

    ``mass``: characters that the pages have in each node of the reference.  A container
    with a varying heading before its main part is kept whole.
    """
    n = len(other.label)
    below, heads = [mass.get(i, 0.0) for i in range(n)], [0] * n
    tag = [x.split(".", 1)[0] for x in other.label]
    for i in range(n - 1, -1, -1):  # children follow their parent
        if i in template:
            below[i] = 0.0
        for c in other.children[i]:
            below[i] += below[c]
            heads[i] += heads[c]
        heads[i] += tag[i] in _HEADINGS and below[i] > 0
    node = 0
    while n and below[0] > 0:
        inner = [c for c in other.children[node] if tag[c] in _CONTAINERS and below[c] >= MAIN_SHARE * below[node]]
        if not inner or any(heads[c] for c in other.children[node] if c < inner[0]):
            break
        node = inner[0]
    return -1 if not n or tag[node] in ("#root", "html", "body") else node


def _contents(page: Page, constant: set[int], top: int | None) -> list[str]:
    """Blocks of the article below ``top``; without one, of the articles of the page, or else of all of it."""
    tags, names, n = page.tags, page.names, len(page.tags)

    def outermost(within: range) -> list[int]:
        out, free = [], 0
        for i in within:
            if i >= free and not page.dropped[i] and _is_article(tags[i], names[i]):
                out.append(i)
                free = page.below(i).stop
        return out

    if top is None:
        tops = outermost(range(n)) or [0]
    else:
        up = top
        while up >= 0:
            if _is_article(tags[up], names[up]) and not page.dropped[up]:
                top = up
            up = page.parent[up]
        within = outermost(page.below(top))
        tops = within if 2 * sum(page.mass[i] for i in within) >= page.mass[top] > 0 else [top]
    out = []
    for t in tops:
        free = 0
        for i in page.below(t):
            if i < free:
                continue
            if tags[i] == "#text":
                if page.said[i] and i not in constant:
                    out.append(page.said[i])
            elif i != t and (page.gone[i] if top is None else _is_dropped(tags[i], names[i], True, page.large(i))):
                free = page.below(i).stop
    return out


def extract(source: str | None, template: dict[str, set[int]] | None = None, slots: dict[str, int] | None = None) -> str:
    """Main text of a page.

    ``template``: packed outline -> its nodes that are template; ``slots``: packed
    outline -> its node that holds the content.  The first outline with such a node in
    the page decides.  A page of template only is its own content.
    """
    if not source:
        return ""
    page = Page(source)
    constant: set[int] = set()
    top = None
    if template or slots:
        own = Outline(page.rows())
        for packed in dict.fromkeys([*(slots or ()), *(template or ())]):
            known, slot = (template or {}).get(packed, ()), (slots or {}).get(packed, -1)
            other = _outline(packed)
            for a, b in align(own, other).items():
                if b in known and own.hash[a] == other.hash[b]:
                    constant.add(a)
                if b == slot and top is None:
                    top = a
    if top is not None and not page.mass[top]:
        top = None
    return "\n".join(_contents(page, constant, top) or _contents(page, set(), top))


def host(url: str = "url"):
    """Host of a url column, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def layout(html: str = "html"):
    """Hash of the distinct block elements, with their classes but without digits; pages made alike share it."""
    opened = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(_OPENED), F.lit(0)))
    bare = F.transform(opened, lambda x: F.regexp_replace(F.lower(x), r"[0-9]+|\s+$", ""))
    return F.xxhash64(F.array_sort(F.array_distinct(F.coalesce(bare, F.array().cast("array<string>")))))


def _groups(pages: DataFrame, url: str, html: str, *more) -> DataFrame:
    return pages.select(host(url).alias("host"), layout(html).alias("layout"), F.col(html).alias("html"), *more)


def references(pages: DataFrame, *, url: str = "url", html: str = "html", count: int = REFERENCES, least: int = LEAST_PAGES) -> DataFrame:
    """(host, layout, refs): outlines of up to ``count`` pages of each host, where the layout is null, and of each layout.

    Layouts that all pages of the host have, or fewer than ``least`` pages, have no
    references of their own.  Pages fall into ``count`` parts by their hash; the smallest hash of a part is taken,
    and the largest ones where parts are empty.  Copies of a page count once.  Hosts without a name have no references.
    """
    keyed = _groups(pages, url, html, F.xxhash64(html).alias("h"))
    named = keyed.where("host <> '' and html is not null and html <> ''")
    # the ends of each remainder of the hash, by partial aggregation: no page is shuffled
    # but a task's best ones
    part = F.pmod("h", F.lit(count)).alias("part")
    ends = named.groupBy("host", "layout", part).agg(F.min(F.struct("h", "html")).alias("lo"), F.max(F.struct("h", "html")).alias("hi"), F.count("*").alias("n"))
    ends = materialise(ends)
    sizes = ends.groupBy("host", "layout").agg(F.sum("n").alias("n"))
    whole = sizes.groupBy("host").agg(F.sum("n").alias("every"))
    own = sizes.join(whole, "host").where((F.col("n") >= least) & (F.col("n") < F.col("every"))).select("host", "layout")
    of_host = ends.groupBy("host", F.lit(None).cast("long").alias("layout"), "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    best = of_host.unionByName(ends.join(own, ["host", "layout"]).select("host", "layout", "part", "lo", "hi"))
    # the smallest of each part first, then the largest
    both = F.concat(F.collect_set(F.struct(F.lit(0).alias("end"), "lo.h", "lo.html")), F.collect_set(F.struct(F.lit(1).alias("end"), "hi.h", "hi.html")))
    listed = best.groupBy("host", "layout").agg(F.array_sort(both).alias("all"))
    chosen = listed.select("host", "layout", F.explode(F.slice(F.array_distinct("all.html"), 1, count)).alias("html"))

    def run(batches):
        for batch in batches:
            packed = [_pack(outline(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, type=pa.string())], names=["host", "layout", "ref"])

    outlines = chosen.mapInArrow(run, "host string, layout long, ref string")
    return outlines.groupBy("host", "layout").agg(F.array_sort(F.collect_set("ref")).alias("refs"))


def _joined(pages: DataFrame, table: DataFrame, column: str, broadcast_bytes: int) -> DataFrame:
    """``pages`` with ``column`` of their host and, as ``own_`` and its name, of their layout; empty without one.

    A small table is sent to all executors.  A larger one is joined, by host and a deal:
    a host has as many deals as 256ths of the pages, so no task gets a large host whole.
    """
    if _small(table, column, broadcast_bytes):
        spread, dealt = F.broadcast, pages.withColumn("deal", F.lit(0))
        copies = table.withColumn("_deal", F.lit(0))
    else:
        counts = pages.groupBy("host").agg(F.count("*").alias("_n"))
        every = counts.agg(F.sum("_n")).first()[0] or 1
        # at most DEALS hosts: bounded in size
        large = F.broadcast(counts.where(F.col("_n") * DEALS > every).select(F.col("host").alias("_h0"), F.ceil(F.col("_n") * DEALS / every).cast("int").alias("_deals")))
        dealt = pages.join(large, F.col("host") == F.col("_h0"), "left").withColumn("deal", F.pmod(F.xxhash64("html"), F.coalesce("_deals", F.lit(1))).cast("int")).drop("_h0", "_deals")
        copies = table.join(large, F.col("host") == F.col("_h0"), "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.coalesce("_deals", F.lit(1)) - 1))).drop("_h0", "_deals")
        spread = lambda df: df
    wide = copies.where("layout is null").select(F.col("host").alias("_h"), F.col("_deal").alias("_d"), F.col(column))
    narrow = copies.where("layout is not null").select(F.col("host").alias("_h2"), F.col("_deal").alias("_d2"), F.col("layout").alias("_l2"), F.col(column).alias(f"own_{column}"))
    dealt = dealt.join(spread(wide), (F.col("host") == F.col("_h")) & (F.col("deal") == F.col("_d")), "left")
    same = (F.col("host") == F.col("_h2")) & (F.col("deal") == F.col("_d2")) & (F.col("layout") == F.col("_l2"))
    return dealt.join(spread(narrow), same, "left").drop("_h", "_h2", "_l2", "_d", "_d2", "deal")


_COUNTS = "host string, layout long, r int, node int, n long, mass long"


def induce(pages: DataFrame, refs: DataFrame, broadcast_bytes: int, *, url: str = "url", html: str = "html", least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """(host, layout, wrapper): each reference with its template nodes and its content slot, from all pages of the host or layout."""
    joined = _joined(_groups(pages, url, html), refs, "refs", broadcast_bytes).where("refs is not null")

    def run(batches):
        counts: Counter = Counter()
        masses: Counter = Counter()
        for batch in batches:
            for part, _ in K.slices(batch, "html"):
                for name, made, source, packed, own in zip(*(c.to_pylist() for c in part.columns)):
                    if not source:
                        continue
                    page = Page(source)
                    shape = Outline(page.rows())
                    same: dict[str, tuple[list[int], Counter]] = {}
                    for group, some in (((name, None), packed), ((name, made), own)):
                        if not some:
                            continue
                        counts[*group, -1, -1] += 1
                        for r, one in enumerate(some):
                            if one not in same:
                                same[one] = matched(page, shape, _outline(one))
                            for b in same[one][0]:
                                counts[*group, r, b] += 1
                            for b, chars in same[one][1].items():
                                masses[*group, r, b] += chars
                if len(counts) + len(masses) > 50_000:
                    yield told(counts, masses)
                    counts, masses = Counter(), Counter()
        if counts:
            yield told(counts, masses)

    def matched(page: Page, shape: Outline, other: Outline) -> tuple[list[int], Counter]:
        """Reference nodes whose text the page repeats, and the page's other text by the node that it falls into."""
        pairs = align(shape, other)
        equal = [b for a, b in pairs.items() if shape.hash[a] and shape.hash[a] == other.hash[b]]
        into, out = [0] * len(page.tags), Counter()
        for a in range(len(page.tags)):
            into[a] = pairs.get(a, into[max(page.parent[a], 0)])
            if shape.hash[a] and not page.dropped[a] and shape.hash[a] != other.hash[pairs.get(a, 0)]:
                out[into[a]] += page.plain[a]
        return equal, out

    def told(counts, masses):
        keys = list(dict.fromkeys([*counts, *masses]))
        columns = [*zip(*keys), [counts[k] for k in keys], [masses[k] for k in keys]]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _COUNTS.split(", ")])

    joined = joined.select("host", "layout", "html", "refs", "own_refs")
    added = [F.sum("n").alias("n"), F.sum("mass").alias("mass")]
    found = materialise(joined.mapInArrow(run, _COUNTS).groupBy("host", "layout", "r", "node").agg(*added))
    # a group is the nodes of one reference
    listed = found.groupBy("host", "layout").agg(
        F.max(F.when(F.col("r") < 0, F.col("n"))).alias("pages"),
        F.collect_list(F.when(F.col("r") >= 0, F.struct("r", "node", "n", "mass"))).alias("found"),
    )
    both = refs.alias("one").join(listed.alias("l"), (F.col("one.host") == F.col("l.host")) & F.col("one.layout").eqNullSafe(F.col("l.layout")))
    both = both.select("one.host", "one.layout", "refs", "pages", "found")

    def decide(batches):
        for batch in batches:
            wrappers = []
            for packed, n, found in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                wrapper = []
                for r, one in enumerate(packed):
                    own = [x for x in found if x["r"] == r]
                    nodes = {x["node"] for x in own if x["n"] >= least and x["n"] >= share * n}
                    slot = _main_slot(_outline(one), nodes, {x["node"]: x["mass"] for x in own}) if n >= least else -1
                    wrapper.append({"ref": one, "nodes": sorted(nodes), "slot": slot})
                wrappers.append(wrapper)
            kind = pa.list_(pa.struct([("ref", pa.string()), ("nodes", pa.list_(pa.int32())), ("slot", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(wrappers, type=kind)], names=["host", "layout", "wrapper"])

    return both.mapInArrow(decide, "host string, layout long, wrapper array<struct<ref:string,nodes:array<int>,slot:int>>")


def _small(df: DataFrame, column: str, most: int) -> bool:
    size = df.agg(F.sum(F.length(F.to_json(F.struct("host", column))))).first()[0] or 0
    return size <= most


def main_text(
    pages: DataFrame,
    keep: list[str],
    *,
    url: str = "url",
    html: str = "html",
    count: int = REFERENCES,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``keep`` columns and ``main_text``, empty if there is none.

    A null or empty page has an empty text; a page without a host is judged on its
    own; copies of a page, and pages with equal ids, all count.  Columns of ``pages`` named like the result are replaced.
    References and wrappers go to all executors while they are small together;
    otherwise they are joined by host and by layout.
    """
    keep = [c for c in keep if c != "main_text"]
    refs = materialise(references(pages, url=url, html=html, count=count))
    wrappers = materialise(induce(pages, refs, broadcast_bytes, url=url, html=html))
    names = {c: f"_in{i}" for i, c in enumerate(keep)}
    source = _groups(pages, url, html, *(F.col(c).alias(n) for c, n in names.items()))
    joined = _joined(source, wrappers, "wrapper", broadcast_bytes).select(*names.values(), "html", "wrapper", "own_wrapper")
    from pyspark.sql import types as T

    fields = [T.StructField(c, joined.schema[n].dataType) for c, n in names.items()]
    out = T.StructType([*fields, T.StructField("main_text", T.StringType())])

    def run(batches):
        for batch in batches:
            for part, _ in K.slices(batch, "html"):
                texts = []
                for source, wrapper, own in zip(*(part.column(len(keep) + i).to_pylist() for i in range(3))):
                    known: dict[str, set[int]] = {}
                    slots: dict[str, int] = {}
                    for w in [*(own or ()), *(wrapper or ())]:
                        known.setdefault(w["ref"], set()).update(w["nodes"])
                        if w["slot"] >= 0:
                            slots.setdefault(w["ref"], w["slot"])
                    texts.append(extract(source, known, slots))
                arrays = [part.column(i) for i in range(len(keep))] + [pa.array(texts, type=pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "main_text"])

    return joined.mapInArrow(run, out)


def op4(spark, sf_dir: str) -> DataFrame:
    """Digest of the contract over all ``pages``."""
    found = main_text(read(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
