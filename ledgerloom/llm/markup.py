"""Blocks of text of a page, and its skeleton of elements, from HTML as it is found."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Fixed values, of the HTML standard: elements that start a new block, that close an open paragraph, without content, with raw text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main"
    " menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul head title".split()
)
CLOSES_P = BLOCKS - frozenset("html head body title caption dd dt li legend optgroup option tbody td tfoot th thead tr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: What an opening tag closes before itself, and the elements that it doesn't look beyond.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head", "title"}, set()),
}
_SCOPE = frozenset("td th caption table html button object template".split())
#: Never text of an article.
DROPPED = frozenset("head title script style noscript noembed noframes template svg nav footer aside form button select textarea iframe object canvas dialog menu search audio video datalist map".split())
_HELD = BLOCKS | DROPPED
#: Class names, ids and roles of what isn't the article either, alone or at an end of a name with hyphens.
CUES = frozenset(
    "nav navbar navigation menu header masthead banner footer sidebar aside cookie cookies consent gdpr notice notices alert popup modal ad ads advert adverts advertisement sponsor sponsored promo"
    " comment comments disqus newsletter subscribe subscription breadcrumb breadcrumbs share sharing social related contentinfo complementary dialog search".split()
)
_NEGATED = frozenset("has with no without is".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption caption".split())
#: Elements below this depth count as their ancestor there in the skeleton; their text stays.
DEEPEST = 100

_TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+>|[^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


class Element:
    __slots__ = ("tag", "label", "cues", "kids", "holds", "main")

    def __init__(self, tag: str, label: str, cues: bool, main: bool):
        self.tag, self.label, self.cues, self.main = tag, label, cues, main
        self.kids: list = []
        self.holds = False  # the article or the main part of the page


def _cue(name: str) -> bool:
    words = re.split(r"[-_]+", name)
    return words[0] not in _NEGATED and bool({name, words[0], words[-1]} & CUES)


def _element(tag: str, attributes: str) -> Element:
    """With its classes, numbers in them left out, as label."""
    label, cue, main = tag, False, tag in ("article", "main")
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()
            main |= (name, value.strip()) in (("role", "main"), ("role", "article"), ("itemprop", "articlebody"))
            if name in ("class", "id", "role"):
                cue |= any(map(_cue, value.split()))
                label += "." + re.sub(r"[^a-z-]+", "", ".".join(sorted(value.split()))) if name == "class" else ""
    return Element(tag, label, cue, main)


def parse(page: str) -> Element:
    """The tree of block elements and dropped ones; text in between, that of links as a tuple. Unclosed and stray tags are as in browsers, nearly."""
    root = Element("", "", False, False)
    stack, at, link = [root], 0, False

    def say(text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            stack[-1].kids.append((text,) if link else text)

    def close(tags: set | frozenset, stop: set | frozenset) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    while m := _TAG.search(page, at):
        say(page[at : m.start()])
        at, tag = m.end(), m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                link = False
            elif tag in _HELD:
                close({tag}, {"table"} if tag in ("p", "li", "div") else frozenset())
            continue
        if tag == "br":
            say(" ")
        elif tag == "a":
            link = True
        elif tag in _HELD and not (tag in VOID and tag != "hr"):
            if tag in CLOSES_P:
                close({"p"}, _SCOPE)
            if tag in IMPLIED:
                # the outermost that it closes: a row takes its cells along
                tags, stop = IMPLIED[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in stop:
                        break
                    if stack[i].tag in tags:
                        del stack[i:]
                        if not {x.tag for x in stack} & tags:
                            break
            new = _element(tag, m[3][:-1])
            stack[-1].kids.append(new)
            if new.main:
                for x in stack:
                    x.holds = True
            if tag != "hr":
                stack.append(new)
            link = False
            if tag in RAW:
                end = _ENDS[tag].search(page, at)
                at = end.start() if end else len(page)
        elif tag in RAW:
            end = _ENDS[tag].search(page, at)
            at = end.start() if end else len(page)
    say(page[at:])
    return root


def _out(x: Element, inside: bool) -> bool:
    """Whether an element isn't part of the article; one that holds the article is."""
    if x.holds or x.tag in ("html", "body"):
        return x.tag == "head"
    if x.tag == "header":
        return not inside
    if x.main and not x.cues:
        return False
    return x.tag in DROPPED or x.cues


class _Node:
    """A node of the skeleton; of a run of alike siblings, all become the first."""

    __slots__ = ("label", "tag", "kids", "depth", "place", "first", "shape")

    def __init__(self, label: str, tag: str, depth: int):
        self.label, self.tag, self.depth = label, tag, depth
        self.kids: list[_Node] = []
        self.place, self.shape = 0, 0
        self.first: _Node | None = None

    def child(self, label: str, tag: str, made: list[_Node]) -> _Node:
        if self.depth >= DEEPEST:
            return self
        made.append(_Node(label, tag, self.depth + 1))
        self.kids.append(made[-1])
        return made[-1]

    def known(self) -> _Node:
        x = self
        while x.first:
            x = x.first
        return x

    def take(self, other: _Node) -> None:
        """Merges a sibling of the run: its children into those with their labels."""
        other.first, equal = self, self.shape == other.shape
        for n, k in enumerate(other.kids):
            mine = self.kids[n] if equal else next((m for m in self.kids if m.label == k.label), None)
            if mine:
                mine.take(k)
            else:
                self.kids.append(k)

    def fold(self) -> None:
        """Alike siblings in a row are one: items and paragraphs of the same label, and what has the same shape besides."""
        kept: list[_Node] = []
        for k in self.kids:
            if kept and kept[-1].label == k.label and (k.tag in PROSE or k.tag == "tr" or kept[-1].shape == k.shape):
                kept[-1].take(k)
            else:
                kept.append(k)
        self.kids = kept
        self.shape = hash((self.label, *(k.shape for k in kept)))


@dataclass
class Page:
    skeleton: str = ""
    declared: bool = False  # the page says what its article is
    texts: list[str] = field(default_factory=list)
    places: list[int] = field(default_factory=list)  # nodes of the skeleton, in its order
    prose: list[bool] = field(default_factory=list)


def blocks(page: str) -> Page:
    """Blocks in page order that may be of the article, each with its node of the skeleton.

    What the page declares as its article, else as its main part, else the whole body; without the elements of ``DROPPED`` and
    those with cues, and without lists of links where nothing is declared. A line break is white space.
    """
    root = parse(page)
    articles = mains = False
    walk = [root]
    while walk:
        x = walk.pop()
        articles |= x.tag == "article"
        mains |= x.main
        walk.extend(k for k in x.kids if k.__class__ is Element and not _out(k, False))
    is_root = (lambda x: x.tag == "article") if articles else (lambda x: x.main)
    made, top = Page(declared=mains), _Node("", "", 0)
    owners: list[_Node] = []
    nodes = [top]
    held: list[str] = []
    linked = 0

    def flush(owner: _Node, tag: str, take: bool) -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text and take and not (not mains and linked >= 0.8 * len(text) and tag not in ("p", "h1", "h2", "h3")):
                made.texts.append(text)
                owners.append(owner)
                made.prose.append(tag in PROSE)
            held.clear()
            linked = 0

    # (element, its node, whether in the article, kids yet to come)
    stack = [(root, top, not mains, iter(root.kids))]
    while stack:
        x, fold, take, kids = stack[-1]
        for k in kids:
            if k.__class__ is not Element:
                if k.__class__ is tuple:
                    k = k[0]
                    linked += len(k.strip())
                held.append(k)
                continue
            flush(fold, x.tag, take)
            below = fold.child(k.label, k.tag, nodes)
            inside = take and mains
            if not _out(k, inside):
                stack.append((k, below, take or (mains and is_root(k)), iter(k.kids)))
                break
        else:
            flush(fold, x.tag, take)
            stack.pop()
    for node in reversed(nodes):  # children before parents
        node.fold()
    out, order = [], [(top, False)]
    n = 0
    while order:
        f, end = order.pop()
        if end:
            out.append(")")
            continue
        f.place = n
        n += 1
        out.append(f.label.replace("(", "").replace(")", "") + "(")
        order.append((f, True))
        order.extend((k, False) for k in reversed(f.kids))
    made.skeleton, made.places = "".join(out), [f.known().place for f in owners]
    return made


def tree(skeleton: str) -> tuple[list[str], list[list[int]]]:
    """Labels and children of the nodes of a skeleton, by their places."""
    labels: list[str] = []
    kids: list[list[int]] = []
    stack: list[int] = []
    for part in re.findall(r"[^()]*\(|\)", skeleton):
        if part == ")":
            stack.pop()
            continue
        if stack:
            kids[stack[-1]].append(len(labels))
        stack.append(len(labels))
        labels.append(part[:-1])
        kids.append([])
    return labels, kids


def aligned(one: str, two: str) -> dict[int, int]:
    """Places of ``two`` and those of ``one`` that match them: simple tree matching, the most nodes in order, equal labels before equal tags."""
    (la, ka), (lb, kb) = tree(one), tree(two)
    tag = lambda s: s.partition(".")[0]
    ta, tb = [tag(x) for x in la], [tag(x) for x in lb]
    known: dict[tuple[int, int], tuple[int, list]] = {}

    def table(a: int, b: int) -> tuple[int, list]:
        if (a, b) in known:
            return known[a, b]
        x, y = ka[a], kb[b]
        m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                w = table(p, q)[0] if ta[p] == tb[q] else 0
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + w if w else 0)
        known[a, b] = (m[-1][-1] + 2 + (la[a] == lb[b]), m)
        return known[a, b]

    out, walk = {}, [(0, 0)]
    while walk:
        a, b = walk.pop()
        out[b] = a
        m, i, j = table(a, b)[1], len(ka[a]), len(kb[b])
        while i and j:
            p, q = ka[a][i - 1], kb[b][j - 1]
            if ta[p] == tb[q] and m[i][j] == m[i - 1][j - 1] + table(p, q)[0]:
                walk.append((p, q))
                i, j = i - 1, j - 1
            elif m[i][j] == m[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return out
