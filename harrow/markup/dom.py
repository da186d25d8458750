"""A tolerant tree for HTML: implied ends, void and raw-text elements, and a subset of CSS selectors."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape as decoded

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript_raw"))
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: an element of this name ends open ones of these names, up to an element of the last set
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "optgroup"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")  # where quotes do not match
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
LONG_REFERENCE = re.compile(r"&#0*+([0-9]*+);?")


def unescape(text: str) -> str:
    """Character references decoded; numbers too long to be a character's are one that is replaced."""
    if "&" not in text:
        return text
    return decoded(text if "&#" not in text else LONG_REFERENCE.sub(lambda m: m[0] if len(m[0]) < 20 else f"&#{m[1] or 0};" if len(m[1]) < 10 else "\ufffd", text))


def without_tags(text: str) -> str:
    """``text`` without what is between < and the next >."""
    out, at = [], 0
    while (begin := text.find("<", at)) >= 0 and (end := text.find(">", begin)) >= 0:
        out.append(text[at:begin])
        at = end + 1
    return "".join([*out, text[at:]])


def whole(text: str | None, default: int, most: int = 1 << 31) -> int:
    """The whole number that ``text`` is, in ASCII digits; ``default`` for anything else and beyond ``most``."""
    return int(text) if text and len(text) < 12 and text.isascii() and text.isdigit() and int(text) <= most else default


def next_token(html: str, at: int, tag: re.Pattern) -> tuple[int, int, re.Match | None, re.Pattern]:
    """(start, end, tag, pattern) of the next comment, declaration (no tag) or tag from ``at``; start -1 when none is left.

    Once a tag's quotes do not match, tags end at the next > for the rest of the page, so that nothing is scanned twice.
    """
    while (stop := html.find("<", at)) >= 0:
        after = html[stop + 1 : stop + 2]
        if after in ("!", "?") and after:
            if html.startswith("<!--", stop):
                end = html.find("-->", stop + 4)
                return stop, end + 3 if end >= 0 else len(html), None, tag
            end = html.find(">", stop)
            return (stop, end + 1, None, tag) if end >= 0 else (-1, -1, None, tag)
        if m := tag.match(html, stop):
            return stop, m.end(), m, tag
        if html.find(">", stop) < 0:
            break  # neither this one ends nor any other
        if tag is TAG and (after == "/" or after.isascii() and after.isalpha()) and (m := LOOSE_TAG.match(html, stop)):
            return stop, m.end(), m, LOOSE_TAG
        at = stop + 1
    return -1, -1, None, tag


class Node:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        todo = self.children[::-1]
        while todo:
            c = todo.pop()
            if isinstance(c, Node):
                yield c
                todo += c.children[::-1]

    def text(self) -> str:
        out: list[str] = []
        todo: list = [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                todo.extend(reversed(n.children))
        return "".join(out)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None


DEEPEST = 200  # as in browsers, what is nested deeper becomes a sibling there
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def parse(html: str) -> Node:
    root = Node("#document", {}, None)
    here, at, end, tag = root, 0, len(html), TAG
    depths, over = {id(root): 0}, []  # of open elements; names of those that are open beyond the deepest

    def close(names: set[str], stop: set[str]) -> None:
        nonlocal here
        n, last = here, None
        while n is not root and n.name not in stop:
            if n.name in names:
                last = n
            n = n.parent
        if last is not None:
            here = last.parent

    while at < end:
        stop = html.find("<", at)
        if m := tag.match(html, stop) if stop >= 0 else None:  # most tokens
            after = m.end()
        else:
            stop, after, m, tag = next_token(html, at, tag)
            if stop < 0:
                stop = after = end
        if stop > at:
            here.children.append(unescape(html[at:stop]))
        at = after
        if m is None:
            continue
        ends, name, rest = m.groups()
        name = name.lower()
        if ends:
            if name in over:
                while over.pop() != name:
                    pass
                continue
            n = here
            while n is not root and n.name != name:
                n = n.parent
            if n is not root:
                here = n.parent
            continue
        if name in CLOSES_P:
            close({"p"}, {"button", "td", "th", "table", "article", "section", "div"})
        if name in IMPLIED:
            close(*IMPLIED[name])
        attrs = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest.rstrip("/"))} if rest else {}
        if "&" in rest:
            attrs = {k: unescape(v) for k, v in attrs.items()}
        node = Node(name, attrs, here)
        here.children.append(node)
        if name in RAW:
            tail = RAW_END[name].search(html, at)
            inner = html[at : tail.start()] if tail else html[at:]
            if inner:
                node.children.append(unescape(inner) if name in ("title", "textarea") else inner)
            at = tail.end() if tail else end
        elif name not in VOID and not rest.endswith("/"):
            if (depth := depths[id(here)] + 1) > DEEPEST:
                over.append(name)
            else:
                depths[id(node)] = depth
                here = node
    return root


PART = re.compile(r"""\s*([>+~])\s*|(\s+)|([a-zA-Z][\w-]*|\*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]|:(first-child|last-child|nth-child\((\d+)\))""")


@lru_cache(maxsize=512)
def compiled(selector: str) -> tuple:
    """Alternatives, each a tuple of (combinator, tests) from left to right."""
    out = []
    for one in _split(selector):
        steps: list[tuple[str, list]] = [(" ", [])]
        at, one = 0, one.strip()
        while at < len(one):
            m = PART.match(one, at)
            if not m:
                raise ValueError(f"selector not understood: {selector}")
            at = m.end()
            tests = steps[-1][1]
            if m[1] or m[2]:
                steps.append((m[1] or " ", []))
            elif m[3]:
                tests.append(("tag", m[3].lower()))
            elif m[4]:
                tests.append(("attr", "id", "=", m[4]))
            elif m[5]:
                tests.append(("class", m[5]))
            elif m[6]:
                tests.append(("attr", m[6].lower(), m[7], next((v for v in (m[8], m[9], m[10]) if v is not None), None)))
            else:
                tests.append((m[11].split("(")[0], m[12]))
        out.append(tuple((c, tuple(t)) for c, t in steps))
    return tuple(out)


def _split(selector: str) -> list[str]:
    return re.split(r",(?![^\[]*\])", selector)


HOLDS = {
    "=": lambda got, want: got == want, "^=": lambda got, want: bool(want) and got.startswith(want), "$=": lambda got, want: bool(want) and got.endswith(want),
    "*=": lambda got, want: bool(want) and want in got, "~=": lambda got, want: want in got.split(), "|=": lambda got, want: got == want or got.startswith(f"{want}-"),
}


@lru_cache(maxsize=512)
def _names(selector: str) -> tuple[frozenset | None, frozenset | None]:
    """Names that an element must have to match, with attributes and without any; None where any name does."""

    def named(ways: list) -> frozenset | None:
        tags = [next((t[1] for t in w[-1][1] if t[0] == "tag" and t[1] != "*"), None) for w in ways]
        return None if None in tags else frozenset(tags)

    ways = compiled(selector)
    return named(list(ways)), named([w for w in ways if not any(t[0] in ("class", "attr") for t in w[-1][1])])


def _passes(n: Node, tests: tuple) -> bool:
    for t in tests:
        kind = t[0]
        if kind == "tag":
            if t[1] != "*" and n.name != t[1]:
                return False
        elif kind == "class":
            if t[1] not in n.classes():
                return False
        elif kind == "attr":
            _, name, op, want = t
            got = n.attrs.get(name)
            if got is None:
                return False
            if op is None:
                continue
            if not HOLDS[op](got, want):
                return False
        else:
            around = n.parent.elements() if n.parent else [n]
            place = {"first-child": 0, "last-child": len(around) - 1, "nth-child": int(t[1] or 1) - 1}[kind]
            if place >= len(around) or around[place] is not n:
                return False
    return True


def _fits(n: Node, steps: tuple, k: int, top: Node) -> bool:
    combinator, tests = steps[k]
    if not _passes(n, tests):
        return False
    if k == 0:
        return True
    if combinator == ">":
        return n.parent is not None and n.parent.name != "#document" and _fits(n.parent, steps, k - 1, top)
    if combinator in "+~":
        around = n.parent.elements()
        i = next(j for j, x in enumerate(around) if x is n)
        return any(_fits(x, steps, k - 1, top) for x in (around[max(0, i - 1) : i] if combinator == "+" else around[:i]))
    up = n.parent
    while up is not None and up.name != "#document":
        if _fits(up, steps, k - 1, top):
            return True
        up = up.parent
    return False


def matching(top: Node, selector: str, among: Iterable[Node]) -> Iterator[Node]:
    """Those of ``among``, elements below ``top`` in document order, that match."""
    ways, (marked, bare) = compiled(selector), _names(selector)
    for n in among:
        names = marked if n.attrs else bare
        if (names is None or n.name in names) and any(_fits(n, w, len(w) - 1, top) for w in ways):
            yield n


def select(top: Node, selector: str) -> list[Node]:
    """Elements below ``top`` that match, in document order."""
    return list(matching(top, selector, top.walk()))


def first(top: Node, selector: str, among: Iterable[Node] | None = None) -> Node | None:
    return next(matching(top, selector, top.walk() if among is None else among), None)
