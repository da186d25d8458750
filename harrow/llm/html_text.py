"""HTML extraction: main text by two passes of block rules.

A page is read once, from left to right, into blocks cut at block-level tags. Pass one classifies each block by length,
link density and the share of stop words in it. Pass two gives every ambiguous short block the label of its nearest
decided neighbour; a heading takes the label of the section that it heads.

What a page says of its parts weighs in, and is weighed against what the parts hold:

* Menus, footers, asides and hidden parts are out, and so are headers that do not belong to an article.
* Forms, and elements whose class or id consists of words like "sidebar", "cookie-notice" or "comment-list", are out
  unless they hold most of the page's running text (``SHARE`` times what the rest holds), as a wrapper of the whole page
  does. Names that only contain such a word ("has-sidebar", "copyright-law") say nothing.
* In an article or main element that holds a fair part of the running text, blocks need fewer stop words, its borders
  count as decided neighbours that are main text, what lies outside is out, and one or two linked blocks in a row are
  ambiguous (a paragraph or an item that is a link); three are a list of links.
* Where no block is long enough to be main text and no part is out, as on a page of one line, ambiguous blocks stay.

Character references are decoded (a number too long to be a character's is one that is replaced), white space within a block becomes one space, blocks are joined in page order by
an empty line. Reading takes time in proportion to the page, however its markup is broken: a tag without an end is the
end of the page, and once quotes do not match, tags end at the next ``>``.

Defined results: null, empty or text-free html gives an empty text; unclosed elements end with their parents, deeply
nested ones need no recursion; a page is held whole by one task and nothing of it is cut; repeated pages repeat; columns
other than the three are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from harrow.llm import arrays as A
from harrow.markup.dom import unescape
from harrow.session import ship

# Frequent function words.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if
    in into is it its may more most no not of on one only or other our out she so some than that the their them then there these
    they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer es für hat ich ihr
    im in ist ja kann mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais me même ne nous on ou où par
    pas plus pour qu que qui sa se ses son sont sur un une vous
    al como con de del desde donde el ella en entre era es esta este fue ha hay la las lo los más me muy no o para pero por porque
    que se ser si sin sobre son su sus también un una y ya
    anche che chi con da dal degli dei della di e gli ha i il la le lo ma nel non per più se si sono su un uno
    ao com da das do dos e em essa este foi isso mais mas na nas no nos o os ou pela pelo por quando são sem seu sua também um uma
    aan bij dat de deze die dit een en er het hij in is maar met naar niet of om ook op te tot uit van voor was wat ze zijn
    """.split()
)
# Elements by their part in a page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())  # hold text without markup
LEFT_OUT = frozenset("noscript template svg select button canvas object audio video datalist annotation annotation-xml".split())
OUTSIDE = frozenset("nav aside footer menu dialog".split())
INLINE = frozenset(
    """
    a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr input link meta
    math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mtable mtr mtd mspace semantics
    """.split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 summary legend caption figcaption dt".split())
CELLS = ("td", "th", "caption")  # an element opened outside ends outside
CLOSE_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
ENDS = {  # an element, the open ones that it ends, and what they have to lie in
    **dict.fromkeys(CLOSE_P, (("p",), (*CELLS, "button"))),
    "li": (("li", "p"), (*CELLS, "ul", "ol", "menu")), "dd": (("dd", "dt", "p"), (*CELLS, "dl")), "dt": (("dd", "dt", "p"), (*CELLS, "dl")), "td": (("td", "th", "p"), ("table", "tr")),
    "th": (("td", "th", "p"), ("table", "tr")), "tr": (("tr", "td", "th", "p"), ("table",)), "tbody": (("tr", "thead", "tbody"), ("table",)), "tfoot": (("tr", "tbody"), ("table",)),
}
# Class and id words of what is not main text; those of reader comments; words that go with either; and words that turn a name into something else.
HINTS = frozenset(
    """
    ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer
    dropdown footer gdpr login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo
    promotion recommended related share sharing sidebar signup skip social sponsor sponsored subscribe subscription tagcloud
    teaser toolbar topbar widget
    """.split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond replies reviews".split())
PLAIN = frozenset(
    """
    area article bar block body bottom box btn button buttons container content default desktop entry feed fixed form global google
    group head header holder icon icons inline inner item items large left link links list listing local main mobile native
    outer page panel post posts primary reader right row secondary section site slot small space sticky story text title top
    unit user wrap wrapper
    """.split()
)
TURNS = frozenset("has have with without no not hide hidden is show layout body open".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
WORD = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPLIT = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")
SHARE = 3  # times the rest of the running text that a part must hold to be the page itself


@dataclass(slots=True)
class Block:
    text: str
    linked: int  # characters inside links
    heading: int  # 1 to 6, 7 for other headings, 0 for none
    outside: bool  # in a part that is never main text
    article: int  # which article or main element it lies in, 0 for none
    part: int = -1  # the innermost part in question that it lies in, -1 for none


@dataclass(slots=True)
class Part:
    """An element that is out unless it holds most of the page."""

    kind: str  # form, named, comments
    parent: int  # the part in question around it, -1 for none
    article: int  # which article or main element it lies in


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}


def named(names: str) -> str:
    """What class or id names say: "comments", "named", "header" or nothing."""
    said = ""
    for name in names.split():
        words = {w.lower() for w in SPLIT.split(name) if w and not w.isdigit()}
        if not words or not TURNS.isdisjoint(words - {"body"} if len(words) > 1 else words):
            continue
        if words <= HINTS | COMMENTS | PLAIN:
            if not COMMENTS.isdisjoint(words):
                return "comments"
            if not HINTS.isdisjoint(words):
                said = "named"
            elif not said and "header" in words and words <= {"header", "site", "page", "top", "main", "global", "wrapper", "container", "inner"}:
                said = "header"
    return said


_judged: dict[tuple[str, str], str] = {}


def judge(name: str, raw: str) -> str:
    """What an element's name and attributes say: "out", "form", "comments", "named", "header" or nothing."""
    if name in OUTSIDE:
        return "out"
    said = "form" if name == "form" else "header" if name == "header" else ""
    if not TELLING.search(raw):
        return said
    if (got := _judged.get((name, raw))) is not None:
        return got
    at = attributes(raw)
    role = at.get("role", "").lower()
    if "hidden" in at or at.get("aria-hidden") == "true" or HIDDEN.search(at.get("style", "")) or (role in ROLES and role != "form"):
        out = "out"
    elif name in ("body", "html"):
        out = ""
    else:
        out = said if said == "form" else named(at.get("class", "") + " " + at.get("id", "")) or said
    if len(_judged) > 4096:
        _judged.clear()
    if len(raw) < 512:
        _judged[name, raw] = out
    return out


class Reader:
    """Reads a page into ``blocks`` and ``parts``."""

    def __init__(self, page: str):
        self.page, self.blocks, self.parts = page, [], []
        self.stack: list[tuple] = []  # open elements: name, and the state before them
        self.places: dict[str, list[int]] = {}  # where in the stack elements of a name stand
        self.text: list[str] = []
        self.linked = self.heading = self.article = self.articles = self.level = 0
        self.outside, self.link, self.part, self.left_out = False, False, -1, 0
        self.missing: set[str] = set()  # elements that end nowhere in the rest of the page
        self.read()
        self.flush()

    def flush(self) -> None:
        if self.text:
            joined = " ".join(unescape("".join(self.text)).split())
            if joined:
                self.blocks.append(Block(joined, min(self.linked, len(joined)), self.heading, self.outside, self.article, self.part))
                self.heading = 0
            self.text.clear()
        self.linked = 0

    def add(self, piece: str) -> None:
        if piece and not self.left_out:
            self.text.append(piece)
            if self.link:
                self.linked += len(" ".join(unescape(piece).split()))

    def ends(self, name: str, at: int) -> int:
        """The place behind the end tag of an element of plain text, -1 where it has none."""
        if name in self.missing:
            return -1
        m = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>", re.I).search(self.page, at)
        if m is None:
            self.missing.add(name)
            return -1
        return m.end()

    def last(self, names) -> int:
        return max((p[-1] for x in names if (p := self.places.get(x))), default=-1)

    def pop_to(self, depth: int) -> None:
        """Close all elements from ``depth`` on."""
        while len(self.stack) > depth:
            name, self.outside, self.part, self.article, self.link, left_out, self.heading = self.stack.pop()
            self.left_out = min(self.left_out, left_out)
            self.places[name].pop()

    def push(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, self.outside, self.part, self.article, self.link, self.left_out, self.heading))

    def read(self) -> None:
        page, at, tag, breaks = self.page, 0, TAG, 0
        while at < len(page):
            stop = page.find("<", at)
            if stop < 0:
                self.add(page[at:])
                return
            if stop > at:
                self.add(page[at:stop])
                if breaks and page[at:stop].strip():
                    breaks = 0
            after = page[stop + 1 : stop + 2]
            if after in ("!", "?"):
                if page.startswith("<!--", stop):
                    end, size = page.find("-->", stop + 4), 3
                elif page.startswith("<![CDATA[", stop) and (end := page.find("]]>", stop)) >= 0:
                    self.add(page[stop + 9 : end])
                    size = 3
                else:
                    end, size = page.find(">", stop), 1
                if end < 0:
                    return
                at = end + size
                continue
            if not (after.isalpha() and after.isascii() or after == "/"):
                self.add("<")
                at = stop + 1
                continue
            m = tag.match(page, stop)
            if m is None:
                if page.find(">", stop) < 0:
                    return  # the page ends within a tag
                if after == "/" and not page[stop + 2 : stop + 3].isalpha():
                    at = page.find(">", stop) + 1
                    continue
                if tag is LOOSE_TAG:
                    self.add("<")
                    at = stop + 1
                else:
                    tag = LOOSE_TAG
                    at = stop
                continue
            at = m.end()
            name, closing, raw = m[2].lower(), bool(m[1]), m[3]
            if name == "br":
                breaks += 1
                self.add(" ")
                if breaks > 1 and not self.left_out:
                    self.flush()
            elif closing:
                breaks = self.close(name, breaks)
            else:
                at, breaks = self.open(name, raw, at, breaks)

    def close(self, name: str, breaks: int) -> int:
        if name == "a":
            self.link = False
            return breaks
        places = self.places.get(name)
        if name in INLINE and not places:
            return breaks
        if name not in INLINE and name not in LEFT_OUT and not self.left_out:
            self.flush()
            breaks = 0
        if places and (name in CELLS or name in ("table", "tr", "tbody", "thead", "tfoot") or places[-1] > self.last(CELLS)):
            if self.left_out and name not in LEFT_OUT and name not in INLINE:
                self.flush()
            self.pop_to(places[-1])
        return breaks

    def open(self, name: str, raw: str, at: int, breaks: int) -> tuple[int, int]:
        if name in RAW:
            end = self.ends(name, at)
            if end < 0:
                return (len(self.page) if name in ("script", "style") else at), breaks
            return end, breaks
        if self.left_out and name not in LEFT_OUT:
            if name not in INLINE and name not in VOID and self.places.get(name):
                self.push(name)  # its end is not the end of one further out
            return at, breaks
        if name in LEFT_OUT:
            if not raw.endswith("/") and self.ends(name, at) >= 0:
                self.push(name)
                self.left_out += 1
            return at, breaks
        if name in INLINE:
            if name == "a":
                self.link = True
            elif name not in VOID and raw and judge(name, raw) == "out" and not raw.endswith("/"):
                self.push(name)
                self.left_out += 1
            elif self.places.get(name):
                self.push(name)
            return at, breaks
        self.flush()
        if name in VOID:
            return at, 0
        if (rule := ENDS.get(name)) is not None:
            ended, scope = rule
            limit = self.last(scope)
            deepest = min((p[-1] for x in ended if (p := self.places.get(x)) and p[-1] > limit), default=-1)
            if deepest >= 0:
                self.pop_to(deepest)
        self.heading = int(name[1]) if name in ("h1", "h2", "h3", "h4", "h5", "h6") else 7 if name in HEADINGS else 0
        if raw.endswith("/"):
            return at, 0
        self.push(name)
        said = judge(name, raw)
        if said == "header" and (self.article or (name == "header" and sum(x[0] not in ("html", "body") for x in self.stack[:4]) > 1)):
            said = ""  # the header of an article
        if said in ("out", "header"):
            self.outside = True
        elif said and not self.outside:
            self.parts.append(Part(said, self.part, self.article))
            self.part = len(self.parts) - 1
        if name in ("article", "main") and not self.outside and not said:
            self.articles += 1
            self.article = self.article or self.articles
        return at, 0


def blocks_of(page: str) -> tuple[list[Block], list[Part]]:
    got = Reader(page)
    return got.blocks, got.parts


def stop_share(text: str) -> float:
    w = WORD.findall(text.lower())
    return sum(x in STOP_WORDS for x in w) / len(w) if w else 0.0


GOOD, BAD, OPEN = 1, 0, -1
LONG, SHORT, HIGH, LOW, LINKS = 140, 70, 0.3, 0.12, 0.4
LIST = 3  # linked blocks in a row that are a list of links


def cut_parts(found: list[Block], parts: list[Part], running: list[int]) -> list[bool]:
    """Which parts are out: those that do not hold most of the page's running text."""
    own = [0] * len(parts)
    loose = [0, 0]  # running text outside of all parts: elsewhere, in articles
    for b, n in zip(found, running, strict=True):
        if not b.outside:
            if b.part >= 0:
                own[b.part] += n
            else:
                loose[b.article > 0] += n
    held = own.copy()
    for k in range(len(parts) - 1, -1, -1):  # a part follows the one around it
        if parts[k].parent >= 0:
            held[parts[k].parent] += held[k]
    total, out = sum(own) + sum(loose), []
    for k, p in enumerate(parts):
        if p.parent >= 0 and out[p.parent]:
            out.append(True)
            continue
        rest = total - held[k]
        wraps = held[k] >= 200 and held[k] >= SHARE * rest
        if p.kind == "comments":
            wraps = wraps and rest == 0 and not p.article
        elif p.kind == "named" and (loose[1] if not p.article else 0):
            wraps = False
        out.append(not wraps)
    return out


def first_pass(found: list[Block], parts: list[Part]) -> tuple[list[int], list[bool], bool]:
    """The labels by the blocks' own text, which blocks lie in parts that are out, and whether the page has an article."""
    shares = [stop_share(b.text) if not b.outside else 0.0 for b in found]
    running = [
        0 if b.heading or b.linked > LINKS * (n := len(b.text)) else n if n >= LONG or (n >= SHORT and share >= HIGH) else 0
        for b, share in zip(found, shares, strict=True)
    ]
    cut = cut_parts(found, parts, running)
    out = [b.outside or (b.part >= 0 and cut[b.part]) for b in found]
    inside = sum(len(b.text) for b, x in zip(found, out, strict=True) if b.article and not x)
    free = sum(n for b, n, x in zip(found, running, out, strict=True) if not b.article and not x)
    contained = inside > 0 and inside >= 0.25 * free
    wide = [share for share, b, x in zip(shares, found, out, strict=True) if not x and len(b.text) >= SHORT]
    known = not wide or max(wide) >= LOW  # else a language without a list here: stop words say nothing
    labels = []
    for b, share, x in zip(found, shares, out, strict=True):
        n = len(b.text)
        if x or (contained and not b.article):
            labels.append(BAD)
        elif b.heading:
            labels.append(OPEN)
        elif b.linked > LINKS * n:
            labels.append(BAD)
        elif n < SHORT:
            labels.append(OPEN)
        elif contained:
            labels.append(GOOD if share >= LOW or n >= LONG else OPEN)
        elif not known:
            labels.append(GOOD if n >= LONG else OPEN)
        elif share >= HIGH or (share >= LOW and n >= LONG):
            labels.append(GOOD)
        elif share >= LOW or n >= LONG:
            labels.append(OPEN)
        else:
            labels.append(BAD)
    return labels, out, contained


def second_pass(found: list[Block], first: list[int], out: list[bool], contained: bool) -> list[int]:
    """Ambiguous blocks take the label of the nearest decided one (of two as near ones main text wins within an article
    only); headings that of their section.

    Within an article only its own blocks are neighbours, and its borders are main text.
    """
    n = len(found)
    places = [i for i in range(n) if found[i].article and not out[i]] if contained else list(range(n))
    labels = list(first)
    m = len(places)
    before, after = [(GOOD, 0)] * m, [(GOOD, 0)] * m
    for nearest, order in ((before, range(m)), (after, range(m - 1, -1, -1))):
        label, far = (GOOD, 1) if contained else (BAD, n + 1)
        for k in order:
            i = places[k]
            if first[i] != OPEN:
                label, far = first[i], 0
            nearest[k] = (label, far)
            far += 1
    for k, i in enumerate(places):
        if first[i] == OPEN and not found[i].heading:
            (x, far_x), (y, far_y) = before[k], after[k]
            labels[i] = x if far_x < far_y or x == y else y if far_y < far_x else GOOD if contained else BAD
    section: int | None = None  # label of what follows up to the next heading, None for nothing
    left, ahead = False, BAD  # whether something that is out stands there; the label of the next heading
    for i in range(n - 1, -1, -1):
        b = found[i]
        if out[i]:
            left = True
        elif not b.heading:
            if not contained or b.article:
                section = GOOD if GOOD in (labels[i], section) else BAD
        elif first[i] == OPEN:
            if contained:
                labels[i] = GOOD if b.heading == 1 or (section == GOOD if section is not None else not left) else BAD
            else:
                labels[i] = ahead if section is None else section
            section, left, ahead = None, False, labels[i]
    return labels


def single_links(found: list[Block], first: list[int], out: list[bool]) -> list[int]:
    """Within an article link density judges lists of links: fewer than ``LIST`` linked blocks in a row are ambiguous."""
    labels, run = list(first), []
    for i, b in enumerate([*found, None]):
        own = b is not None and b.article and not out[i]
        if own and not b.heading and b.linked > LINKS * len(b.text):
            run.append(i)
        elif own or b is None:
            if len(run) < LIST:
                for k in run:
                    labels[k] = OPEN
            run = []
    return labels


def labels(found: list[Block], parts: list[Part]) -> list[int]:
    """Both passes over a page's blocks. Where nothing says what main text is and no part is out, ambiguous blocks stay."""
    first, out, contained = first_pass(found, parts)
    if contained:
        first = single_links(found, first, out)
    elif GOOD not in first and not any(out):
        return [GOOD if x == OPEN else x for x in first]
    return second_pass(found, first, out, contained)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found, parts = blocks_of(page)
    return "\n\n".join(b.text for b, x in zip(found, labels(found, parts), strict=True) if x == GOOD)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page. One pass, no shuffle."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(A.tidied(run), f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
