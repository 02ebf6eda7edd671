"""A page's markup as a flat list of elements, each with its parent, and its text in page order.

Only what text needs: which element closes which, which are blocks, what is never shown. Nothing recurses, so depth
doesn't matter, and each page is read once from left to right.
"""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass, field

# Kinds of elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul""".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CELLS = frozenset(("td", "th"))
IN_HEAD = frozenset("title meta link script style base noscript template".split())
HIDDEN = frozenset("head script style noscript template iframe svg canvas video audio object embed map title textarea select button datalist xmp noembed noframes".split())
#: What a start tag closes, and the elements at which the search for it ends.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tr": (("tr", "caption"), ("table",)),
    "tbody": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "body": (("head",), ("body",)),
}
# Tags, roles and words of class and id names that mark what is not the article.
BOILERPLATE = frozenset("nav aside footer form dialog menu search fieldset".split())
ROLES = frozenset("navigation contentinfo complementary search alert alertdialog dialog form menu menubar toolbar tablist".split())
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsbygoogle alert banner breadcrumb breadcrumbs comment comments commentlist consent
    cookie cookies disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications overlay pager
    pagination popup promo promotion recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar""".split()
)
COMMENTS = frozenset(("comment", "comments", "commentlist", "replies", "disqus", "respond"))
#: A header belongs to the page, or to the article that it stands in.
HEADER = "header"

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:"[^"]*"|'[^']*')?)*+)>|</?[a-zA-Z].*\Z|<[!?/][^>]*(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

#: Why an element is no part of the article: it never is shown or is of such a kind, its names say so, it is a page's header, or it has text of readers.
SHOWN, KIND, NAMED, HEAD, READERS = range(5)


@dataclass
class Tree:
    """names, parents and marks of elements in page order; events are (element, text), (element, None) where a block begins or ends, and (element, True) where it starts."""

    names: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    marks: list[int] = field(default_factory=lambda: [SHOWN])
    events: list[tuple] = field(default_factory=list)


def _mark(name: str, written: str) -> int:
    if name in HIDDEN or name in BOILERPLATE:
        return KIND
    mark = HEAD if name == HEADER else SHOWN
    if "=" not in written and "hidden" not in written:
        return mark
    for m in _ATTRIBUTE.finditer(written):
        key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if key == "role":
            mark = KIND if value.lower() in ROLES else HEAD if value.lower() == "banner" else mark
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return KIND
        elif key in ("class", "id"):
            for word in value.split():
                parts = [x.lower() for x in _PARTS.findall(word)]
                if len(parts) > 3:
                    continue
                if not COMMENTS.isdisjoint(parts):
                    return READERS
                if not NAMES.isdisjoint(parts):
                    mark = NAMED
                elif HEADER in parts and mark == SHOWN:
                    mark = HEAD
    return mark


def parse(page: str) -> Tree:
    """The elements and text of a page; one that breaks off or whose tags don't match is read as far as it goes, as browsers do."""
    tree = Tree()
    names, parents, marks, events = tree.names, tree.parents, tree.marks, tree.events
    stack = [0]

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            if names[node] in BLOCKS:
                events.append((node, None))

    def close_within(targets: tuple[str, ...], until: tuple[str, ...]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            name = names[stack[depth]]
            if name in targets:
                return close(depth)
            if name in until:
                return None
        return None

    def text(piece: str) -> None:
        if names[stack[-1]] == "head" and not piece.isspace():
            close(len(stack) - 1)
        events.append((stack[-1], html.unescape(piece) if "&" in piece else piece))

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in ("body", "html"):
                continue
            for depth in range(len(stack) - 1, 0, -1):
                here = names[stack[depth]]
                if here == name or (name in HEADINGS and here in HEADINGS):
                    close(depth)
                    break
                if (name not in BLOCKS and name not in CELLS and here in BLOCKS) or here in CELLS and name not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
            if name in BLOCKS:  # an end tag without a start still ends a block
                events.append((stack[-1], None))
            elif name == "br":
                events.append((stack[-1], " "))
            continue
        if names[stack[-1]] == "head" and name not in IN_HEAD:
            close(len(stack) - 1)
        if name in BLOCKS:
            depth = len(stack) - 1
            while depth and names[stack[depth]] not in BLOCKS and names[stack[depth]] not in CELLS:
                depth -= 1
            if names[stack[depth]] == "p" or (name in HEADINGS and names[stack[depth]] in HEADINGS):
                close(depth)
        if name in CLOSES:
            close_within(*CLOSES[name])
        node = len(names)
        names.append(name)
        parents.append(stack[-1])
        marks.append(_mark(name, m[3]))
        events.append((node, True))
        if name in BLOCKS:
            events.append((node, None))
        elif name == "br" or name in CELLS:
            events.append((node, " "))
        if name in RAW:
            end = _ENDS[name].search(page, at)
            at = len(page) if end is None else end.start()
        if name not in VOID:
            stack.append(node)
    if at < len(page):
        text(page[at:])
    return tree


def unwanted(tree: Tree) -> tuple[list[bool], list[bool]]:
    """Which elements are no part of the article, by kind and name, and which stand within one that is the article or the page's main part.

    What holds the page's first article isn't removed for its names, nor a form around it. The first article is the first of those in the fewest elements
    with such names, and in no other unwanted one.
    """
    n = len(tree.names)
    holds, under, best, first = set(), [0] * n, n, -1
    for i in range(1, n):
        mark = SHOWN if tree.marks[i] == HEAD or tree.names[i] == "form" else tree.marks[i]
        under[i] = under[tree.parents[i]] + (0 if mark == SHOWN else 1 if mark == NAMED else n)
        if tree.names[i] in ("article", "main") and mark == SHOWN and under[i] < best:
            best, first = under[i], i
    while first >= 0:
        holds.add(first)
        first = tree.parents[first]
    gone, inside = [False] * n, [False] * n
    for i in range(1, n):
        up, mark = tree.parents[i], tree.marks[i]
        inside[i] = inside[up] or tree.names[i] in ("article", "main")
        own = mark in (NAMED, READERS) or (mark == KIND) or (mark == HEAD and not inside[i])
        gone[i] = gone[up] or (own and not (i in holds and (mark != KIND or tree.names[i] == "form")))
    return gone, inside


def digests(tree: Tree, gone: list[bool]) -> list[int]:
    """A 64-bit hash of the subtree of each element: names and text, without attributes and what is gone; 0 where there is no text."""
    content: list[list] = [[] for _ in tree.names]
    for node, what in tree.events:
        if gone[node]:
            continue
        if what is True:
            content[tree.parents[node]].append(node)
        elif what and not what.isspace():
            content[node].append(" ".join(what.split()).encode("utf-8", "replace"))
    out = [0] * len(tree.names)
    for node in range(len(tree.names) - 1, -1, -1):
        parts = [out[x].to_bytes(8, "little") if isinstance(x, int) else x for x in content[node] if not isinstance(x, int) or out[x]]
        if parts:
            out[node] = int.from_bytes(hashlib.blake2b(b"\0".join([tree.names[node].encode("utf-8", "replace"), *parts]), digest_size=8).digest(), "little") or 1
    return out


def roots(tree: Tree, gone: list[bool]) -> set[int]:
    """The elements whose text is the article: the one outermost article, or the main part, or all articles, or else the page."""
    kept: dict[str, list[int]] = {"article": [], "main": []}
    within: dict[str, list[bool]] = {k: [False] * len(gone) for k in kept}
    for i in range(1, len(gone)):
        for name, found in kept.items():
            here = within[name][tree.parents[i]]
            if tree.names[i] == name and not here and not gone[i]:
                found.append(i)
            within[name][i] = here or tree.names[i] == name
    if len(kept["article"]) == 1:
        return set(kept["article"])
    return set(kept["main"] or kept["article"] or [0])


def article(tree: Tree, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """The article's blocks, one a line, without the subtrees whose digests are templates (see removable)."""
    gone, inside = unwanted(tree)
    if templates:
        own = digests(tree, gone)
        for i in range(1, len(gone)):
            gone[i] = gone[i] or gone[tree.parents[i]] or (own[i] in templates and removable(tree, i, inside))
    tops, taken = roots(tree, gone), [False] * len(gone)
    taken[0] = 0 in tops
    for i in range(1, len(gone)):
        taken[i] = not gone[i] and (taken[tree.parents[i]] or i in tops)
    blocks, pieces = [], []
    for node, what in tree.events:
        if what is None:
            if pieces:
                blocks.append(" ".join("".join(pieces).split()))
                pieces = []
        elif what is not True and taken[node]:
            pieces.append(what)
    if pieces:
        blocks.append(" ".join("".join(pieces).split()))
    return "\n".join(x for x in blocks if x)


#: Within an article only these go as templates, not a paragraph or heading by itself: articles may share lines.
CONTAINERS = frozenset("div section ul ol dl table figure details".split())


def removable(tree: Tree, node: int, inside: list[bool]) -> bool:
    name = tree.names[node]
    return name in BLOCKS and name not in ("html", "body", "article", "main") and (not inside[node] or name in CONTAINERS)
