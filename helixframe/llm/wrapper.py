"""Wrappers of web pages: what the pages of a host have in common, as a union-free regular expression.

A page is read as a stream of block tags and texts.  A wrapper is such a stream with groups that are optional (?) or
repeated (+) and with slots for texts.  Two streams are aligned level by level.  What both have with the same text anchors the
alignment; between anchors, neighbours that repeat a shape become one repeated group, shapes in common
are aligned, and what only one stream has becomes an optional group.  Texts that differ make their slot variable; a slot with one
text on all its pages stays apart from variable ones, so that a notice between paragraphs is told from them.  Groups on less
than one in ``RARE`` pages become a wildcard (``*``), which bounds a wrapper by what its pages hold, not by their number.

A page is read by matching it to the wrapper: every box and text falls to the group that it repeats, or to none.

Boxes nest as deep as a page says; the functions that follow them call each other from Python alone, which takes no stack of the
interpreter's own.
"""

from __future__ import annotations

import html as entities
import re
import sys
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Fixed values of HTML: what takes no end tag, what never shows, and what starts or ends a block of text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|template|iframe|svg|math|select|option|button|object|audio|video|canvas|noframes"
SLOTS = set("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th caption figcaption address summary legend".split())
BOXES = set("html head body article main section div nav header footer aside form ul ol dl table thead tbody tfoot tr figure details fieldset menu dialog center hgroup search".split())
#: Boxes that never hold an article, by their name or by a word of their class, id or role.
APART = set("head nav header footer aside form menu dialog fieldset search".split())
APART_WORDS = re.compile(
    r"(?:^|[^a-z])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar|side-bar|footer|header|masthead|cookie\w*|consent|notices?|newsletter|subscri\w*|sign-?up|login|comments?|disqus|replies|related|recommend\w*|pagination|pager|skip-link|complementary|contentinfo|navigation)(?:$|[^a-z])"
)
#: Words of boxes that may as well hold what a page is about (share-price): apart unless their text changes from page to page.
PERHAPS_WORDS = re.compile(r"(?:^|[^a-z])(?:alert|popup|modal|overlay|respond|share|sharing|social|widget|toolbar)(?:$|[^a-z])")
#: An article may be a reader's comment or a teaser. A class like with-sidebar says what stands beside a box.
ARTICLE_APART = re.compile(r"(?:^|[^a-z])(?:comments?|reply|replies|ad|ads|advert\w*|sponsor\w*|promo\w*|related|recommend\w*|teaser)(?:$|[^a-z])")
_ABOUT = re.compile(r"(?:^|[^a-z])(?:has|with|no|without|hide|show)[-_][a-z_-]+")
CONTENT_WORDS = re.compile(r"(?:^|[^a-z])(?:article|articlebody|article-body|post|post-body|post-content|entry|entry-content|content|main|main-content|story|story-body|body-text)(?:$|[^a-z])")

#: Where a comment, a declaration or a tag begins. A tag's attributes are taken once, whether or not the tag is closed.
_BEGIN = re.compile(r"<(?:(?P<other>!--|!\[CDATA\[|[!?])|(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*))", re.I)
_REST = re.compile(r"(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?P<close>>?)")
_RAW = re.compile(rf"<(?P<raw>{RAW})\b", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW.split("|")}
_SIGNS = re.compile(r"[\"'>]")
_LONG_NUMBER = re.compile(r"&#[0-9]{1000,};?")
#: A tag that the page's end cuts off is no text.
_CUT_OFF = re.compile(r"<[a-z/!?][^<>]*\Z", re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: A group on fewer pages than one in RARE is no group of its own.
RARE, WILDCARD = 100, "*"

sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


@dataclass
class Node:
    """A group of the expression. sign: tag and marks; mark: of its text; pages: how many have it; chars: of text in it, on all pages."""

    sign: str
    slot: bool = False
    children: list[Node] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False
    variable: bool = False
    mark: int = 0
    pages: int = 1
    chars: int = 0
    texts: list[str] = field(default_factory=list, repr=False)

    def plain(self) -> list:
        """The tree as one flat list, each node before its children."""
        out: list = []
        left = [self]
        while left:
            n = left.pop()
            out += (n.sign, n.slot + 2 * n.optional + 4 * n.repeated + 8 * n.variable, n.mark, n.pages, n.chars, len(n.children))
            left.extend(reversed(n.children))
        return out

    @staticmethod
    def of(x: list) -> Node:
        root, open_ = None, []
        for i in range(0, len(x), 6):
            sign, flags, mark, pages, chars, children = x[i : i + 6]
            n = Node(sign, bool(flags & 1), [], bool(flags & 2), bool(flags & 4), bool(flags & 8), mark, pages, chars)
            if root is None:
                root = n
            else:
                while not open_[-1][1]:
                    open_.pop()
                open_[-1][0].children.append(n)
                open_[-1][1] -= 1
            open_.append([n, children])
        return root

    def expression(self) -> str:
        """The wrapper as text, for people: boxes as <sign>(...), slots as #sign, groups with ? and +."""
        inner = f"#{self.sign}" if self.slot else f"<{self.sign}>({' '.join([c.expression() for c in self.children])})"
        return inner + "+" * self.repeated + "?" * self.optional


def _name(node: Node) -> str:
    return node.sign.split("|", 1)[0]


class _Ends:
    """Where tags end: the first > outside quotes. Asked for a page once a tag on it isn't closed, since a search from every such tag
    would read the rest of the page again and again."""

    def __init__(self, html: str, begin: int):
        self.at, signs = array("q"), bytearray()
        for m in _SIGNS.finditer(html, begin):
            self.at.append(m.start())
            signs.append(ord(m[0]))
        self.ends = array("q", bytes(8 * len(signs)))
        outside = double = single = -1  # the end of a tag that is outside quotes, or inside either kind, at the sign
        for k in range(len(signs) - 1, -1, -1):
            if signs[k] == 62:
                outside = self.at[k]
            elif signs[k] == 34:
                outside, double = double, outside
            else:
                outside, single = single, outside
            self.ends[k] = outside

    def of(self, position: int) -> int:
        """-1 if there is none."""
        k = bisect_left(self.at, position)
        return self.ends[k] if k < len(self.at) else -1


def tokens(html: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """begin, end, name (None for what is no tag), whether it is an end tag, and the attributes or the text of a CDATA section.

    An element of RAW is one token, up to its end tag or the end of the page. Every page takes time in proportion to its length.
    """
    at, ends, last_section = 0, None, None
    while m := _BEGIN.search(html, at):
        begin, at = m.start(), m.end()
        if m["other"]:
            if m["other"] == "![CDATA[" or m["other"].upper() == "![CDATA[":
                last_section = html.rfind("]]>") if last_section is None else last_section
                if last_section >= at:
                    end = html.index("]]>", at)
                    yield begin, end + 3, None, False, html[at:end]
                    at = end + 3
                    continue
            stop = "-->" if m["other"] == "!--" else ">"
            end = html.find(stop, at)
            at = len(html) if end < 0 else end + len(stop)
            yield begin, at, None, False, ""
            continue
        if ends is None:
            rest = _REST.match(html, at)
            end = rest.end() - 1 if rest["close"] else -1
            if end < 0:
                ends = _Ends(html, at)
        else:
            end = ends.of(at)
        if end < 0:
            at = begin + 1  # no tag
            continue
        attributes, at = html[at:end], end + 1
        raw = None if m["end"] else _RAW.match(html, begin)
        if raw:
            closing = _RAW_END[raw["raw"].lower()].search(html, at)
            at = closing.end() if closing else len(html)
            yield begin, at, None, False, ""
        else:
            yield begin, at, m["tag"].lower(), bool(m["end"]), attributes


def unescape(text: str) -> str:
    """Character references as characters; numbers of a thousand digits are beyond every character, as all too large ones."""
    return entities.unescape(_LONG_NUMBER.sub("\ufffd", text) if "&#" in text else text)


def parse(html: str) -> Node:
    """The boxes of a page and the texts in them. Inline tags are part of texts; unclosed and stray tags are borne with."""
    root = Node("#page")
    stack, words, leaf, boxes = [root], [], ["#text"], [root]
    open_: dict[str, int] = {}  # how many boxes of a name are open

    def close_text() -> None:
        text = " ".join(unescape("".join(words)).split())
        words.clear()
        if text:
            stack[-1].children.append(Node(leaf[0], True, mark=zlib.crc32(text.encode()), chars=len(text), texts=[text]))

    at = 0
    for begin, end, name, ends, attributes in tokens(html):
        words.append(html[at:begin])
        at = end
        if name is None:
            words.append(attributes)
            continue
        if name in SLOTS or name in ("br", "hr"):
            close_text()
            if name in SLOTS:
                leaf[0] = "#text" if ends else name
        elif name in BOXES:
            close_text()
            leaf[0] = "#text"
            if not ends:
                if name in ("html", "head", "body") and open_.get(name):
                    continue
                if name == "body":
                    while len(stack) > 1 and _name(stack[-1]) != "html":
                        open_[_name(stack.pop())] -= 1
                marks = [f"{a.lower()}={' '.join(sorted(re.sub('[0-9]+', '0', v or w or x).lower().split()))}" for a, v, w, x in _ATTRIBUTE.findall(attributes)]
                box = Node("|".join([name, *sorted(marks)]))
                stack[-1].children.append(box)
                stack.append(box)
                boxes.append(box)
                open_[name] = open_.get(name, 0) + 1
            elif name not in ("html", "body") and open_.get(name):  # what follows html and body still belongs to them
                while True:
                    closed = _name(stack.pop())
                    open_[closed] -= 1
                    if closed == name:
                        break
    words.append(_CUT_OFF.sub("", html[at:]))
    close_text()
    for box in reversed(boxes):  # what is inside a box comes before it
        box.mark = zlib.crc32(repr([(c.sign, c.mark) for c in box.children]).encode("utf-8", "surrogatepass"))
    return root


def settled(node: Node, pages: int) -> bool:
    """Whether a group of a wrapper of so many pages has the same text on all of its pages, which are not few."""
    return not node.variable and node.pages >= 2 and 4 * node.pages >= pages


def _merge(a: Node, b: Node, pages: int, own: int | None = None) -> Node:
    """Two groups of one sign as one, on `own` pages."""
    return Node(
        a.sign,
        a.slot,
        align(a.children, b.children, pages),
        a.optional or b.optional,
        a.repeated or b.repeated,
        a.variable or b.variable or a.mark != b.mark,
        a.mark,
        a.pages + b.pages if own is None else own,
        a.chars + b.chars,
    )


def fold(nodes: list[Node], pages: int) -> list[Node]:
    """Neighbours, single or in units of up to four, that repeat a shape become repeated groups, and rare neighbours a wildcard."""
    out: list[Node] = []
    for n in nodes:
        if n.optional and RARE * n.pages < pages:
            if out and out[-1].sign == WILDCARD:
                last = out[-1]
                last.pages, last.chars = max(last.pages, n.pages), last.chars + n.chars
                continue
            n = Node(WILDCARD, False, [], True, True, True, 0, n.pages, n.chars)
        out.append(n)
    for unit in range(1, 5):
        nodes, out = out, []
        for n in nodes:
            out.append(n)
            tail, before = out[-unit:], out[-2 * unit : -unit]
            if len(before) == unit and [x.sign for x in tail] == [x.sign for x in before] and not any([settled(x, pages) for x in out[-2 * unit :]]):
                out[-2 * unit :] = [_repeated(x, y, pages) for x, y in zip(before, tail)]
    return out


def _repeated(a: Node, b: Node, pages: int) -> Node:
    """Two neighbours of one shape on the same pages as one repeated group."""
    one = _merge(a, b, pages, max(a.pages, b.pages))
    one.repeated = True
    return one


def anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Of keys, which stand once in a list (None is no key), the longest run of pairs (place in a, place in b) that ascends in both."""
    there = {k: j for j, k in enumerate(b) if k is not None}
    pairs = [(i, there[k]) for i, k in enumerate(a) if k in there]
    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):  # patience: the least last place of a run of each length
        k = bisect_left(ends, j)
        ends[k:], at[k:] = [j, *ends[k + 1 :]], [n, *at[k + 1 :]]
        before[n] = at[k - 1] if k else -1
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _counted(keys: list) -> list:
    """Each key with how often it came before."""
    seen: dict = {}
    for k in keys:
        seen[k] = seen.get(k, 0) + 1
    out = []
    for k in reversed(keys):
        out.append(None if k is None else (k, seen[k]))
        seen[k] -= 1
    return out[::-1]


def _text_keys(nodes: list[Node]) -> list:
    return _counted([None if n.variable else (n.sign, n.mark) for n in nodes])


def _shape_keys(nodes: list[Node], pages: int) -> list:
    """Settled groups match nothing that isn't equal."""
    return _counted([None if settled(n, pages) else n.sign for n in nodes])


def align(a: list[Node], b: list[Node], pages: int) -> list[Node]:
    """Two streams of one level as one; `pages` are those of both together."""
    out: list[Node] = []
    i = j = 0
    for x, y in [*anchors(_text_keys(a), _text_keys(b)), (len(a), len(b))]:
        out += _between(a[i:x], b[j:y], pages)
        if x < len(a):
            out.append(_merge(a[x], b[y], pages))
        i, j = x + 1, y + 1
    return fold(out, pages)


def _between(a: list[Node], b: list[Node], pages: int) -> list[Node]:
    """What stands between two anchors: shapes in common, the rest optional."""
    if not a and not b:
        return []
    a, b = fold(a, pages), fold(b, pages)
    out, i, j = [], 0, 0
    for x, y in [*anchors(_shape_keys(a, pages), _shape_keys(b, pages)), (len(a), len(b))]:
        for n in [*a[i:x], *b[j:y]]:
            n.optional = True
            out.append(n)
        if x < len(a):
            out.append(_merge(a[x], b[y], pages))
        i, j = x + 1, y + 1
    return out


def wrap(page: Node) -> Node:
    """A page as a wrapper of its own."""
    return page


def combine(a: Node, b: Node) -> Node:
    """Two wrappers (or a wrapper and a page) as one. Their nodes are used up."""
    return _merge(a, b, a.pages + b.pages)


def apart(sign: str, changes: bool = False) -> bool:
    """Whether a box is a menu, header, footer, sidebar, notice, advert, form or the readers' comments. changes: its text is known to
    be another on other pages, which tells where words leave it open."""
    name, *marks = sign.split("|")
    if name in APART:
        return True
    if name in ("html", "body"):
        return False
    words = [ARTICLE_APART] if name in ("article", "main") else [APART_WORDS] if changes else [APART_WORDS, PERHAPS_WORDS]
    return any([w.search(_ABOUT.sub(" ", m.split("=", 1)[1])) for m in marks for w in words])


def fixed(node: Node, within: int) -> bool:
    """Whether a slot has the same text on nearly all of the pages (three at least) that have the box around it."""
    return not node.variable and within >= 3 and 10 * node.pages >= 9 * within


def _walk(wrapper: Node):
    """(node, number of the box around it, its own number if it is a box), each after the box around it; boxes from 0."""
    left, count = [(wrapper, -1)], 0
    while left:
        node, parent = left.pop()
        own = -1
        if not node.slot:
            own, count = count, count + 1
            left.extend([(c, own) for c in reversed(node.children)])
        yield node, parent, own


def fixed_texts(wrapper: Node) -> list[int]:
    """The marks of texts that are the same on more than half of a wrapper's pages."""
    if wrapper.pages < 2:
        return []
    return sorted({n.mark for n, _, _ in _walk(wrapper) if n.slot and not n.variable and 2 * n.pages > wrapper.pages})


@dataclass
class Box:
    """Where an article is: rank (3 article elements, 2 main ones, 1 boxes marked as content, 0 others), weight of its text, way to it."""

    rank: int
    weight: float
    path: tuple[str, ...]


def main_box(wrapper: Node, known: frozenset[int] = frozenset()) -> Box:
    """The box with the article: of article and main elements, then of boxes marked as content, then of all, the one with the most
    text; texts that are the same on every page, or whose marks are known to be, count a tenth."""
    boxes: list[Node] = []
    parents: list[int] = []
    out: list[bool] = []  # apart, or inside what is
    ranks: list[int] = []
    direct: list[float] = []  # the text of a box's own slots
    for node, parent, own in _walk(wrapper):
        if node.slot:
            changes = node.variable or (wrapper.pages == 1 and node.mark not in known)
            direct[parent] += node.chars * (1.0 if changes else 0.1)
            continue
        name, *marks = node.sign.split("|")
        boxes.append(node)
        parents.append(parent)
        direct.append(0.0)
        out.append(parent >= 0 and (out[parent] or node.sign == WILDCARD or apart(node.sign, node.variable and wrapper.pages >= 3)))
        if name == "article" or "itemprop=articlebody" in marks:
            ranks.append(3)
        elif name == "main" or "role=main" in marks:
            ranks.append(2)
        else:
            ranks.append(int(any([CONTENT_WORDS.search(m.split("=", 1)[1]) for m in marks])))
    whole = list(direct)
    for k in range(len(boxes) - 1, 0, -1):
        if not out[k]:
            whole[parents[k]] += whole[k]
    found = [(ranks[k], whole[k] if ranks[k] else direct[k], -k) for k in range(len(boxes)) if not out[k]]
    rank, weight, k = max([f for f in found if f[1] > 0] or found)
    path = []
    at = -k
    while parents[at] >= 0:
        path.append(boxes[at].sign)
        at = parents[at]
    return Box(rank, weight, tuple(reversed(path)))


def matched(page: list[Node], wrapper: list[Node]) -> list[Node | None]:
    """For each node of a level of a page the group of the wrapper that it falls to: one with the same text, else one of its
    shape, in order as far as that goes; a repeated group takes any number."""
    out: list[Node | None] = [None] * len(page)
    i = j = 0
    for x, y in [*anchors(_text_keys(page), _text_keys(wrapper)), (len(page), len(wrapper))]:
        shapes: dict[str, list[int]] = {}
        for k in range(j, y):
            shapes.setdefault(wrapper[k].sign, []).append(k)
        at = j
        for k in range(i, x):
            own = shapes.get(page[k].sign)
            if own:
                n = bisect_left(own, at)
                at = own[min(n, len(own) - 1)]
                out[k] = wrapper[at]
                at += not wrapper[at].repeated
        if x < len(page):
            out[x] = wrapper[y]
        i, j = x + 1, y + 1
    return out


def texts_at(page: Node, box: Box, wrapper: Node | None = None) -> list[str] | None:
    """The blocks in the boxes that a path leads to, in page order; None if there is no such box.

    With the wrapper of the page's host, texts that stand first or last in a box of no telling name on nearly all pages are left out,
    unless nothing else is in it. What is the same on all pages between texts that change is part of the article.
    """
    here: list[tuple[Node, Node | None]] = [(page, wrapper)]
    for sign in box.path:
        here = [(c, w) for n, m in here for c, w in _paired(n, m) if c.sign == sign]
    if not here:
        return None
    many = wrapper is not None and wrapper.pages >= 3
    every: list[str] = []
    own: list[str] = []
    for node, group in here:
        pairs = _paired(node, group)
        kept = pairs
        if many and box.rank < 2 and group is not None:
            notice = [c.slot and w is not None and fixed(w, group.pages) for c, w in pairs]
            first = notice.index(False) if False in notice else len(notice)
            last = len(notice) - (notice[::-1].index(False) if False in notice else 0)
            kept = pairs[first:last]
        for out, some in ((every, pairs), (own, kept)):
            left = some[::-1]
            while left:
                n, w = left.pop()
                if n.slot:
                    out += n.texts
                elif not apart(n.sign, many and w is not None and w.variable):
                    left += _paired(n, w)[::-1]
    return own or every


def _paired(node: Node, group: Node | None) -> list[tuple[Node, Node | None]]:
    return list(zip(node.children, matched(node.children, group.children) if group is not None else [None] * len(node.children)))
