"""What is read from a document tree: noise removal, Markdown, structured data, items, patterns, media, articles."""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from urllib.parse import urljoin

from harrow.markup.dom import Node, first, matching, parse, select, whole

# What is no content, by selector.
NOISE = (
    ".advertisement, .ad, [class*='ad-'], [class*='ads-'], [id*='ad-'], .ad-container, .ad-wrapper, .adsbygoogle, .cookie-banner, .cookie-consent, .cookie-notice, "
    "[class*='cookie'], .consent-banner, #cookie-notice, #gdpr, .popup, .modal, .overlay, [class*='popup'], [class*='modal'], .social-share, .share-buttons, .social-links, "
    "[class*='share-'], [class*='social-'], .comments, .comment-section, #comments, [class*='comment'], .related-articles, .recommended, [class*='related-'], "
    "[class*='recommended'], [role='navigation'], [role='banner'], [role='complementary'], aside, [class*='sidebar'], [class*='newsletter'], [class*='subscribe'], "
    "[class*='signup'], .breadcrumb, .breadcrumbs, [class*='breadcrumb']"
)
DROPPED = frozenset("script style nav footer header noscript iframe svg head title".split())
PAGERS = ("a.load-more", "a.next", "a[rel='next']", "[class*='pagination'] a:last-child", "[class*='load-more']", "a[class*='next']")
VALUE_OF = {"meta": "content", "a": "href", "link": "href", "img": "src", "time": "datetime"}
HEADS = {f"h{k}": "#" * k + " " for k in range(1, 7)}


def collapse(text: str) -> str:
    return re.sub(r"\s+", " ", text)


def cleaned(root: Node) -> Node:
    for n in select(root, NOISE):
        n.remove()
    return root


def markdown(root: Node) -> str:
    """ATX headings, fenced code, dashes for bullets, pipe tables."""
    text = _blocks(root)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _inline(n) -> str:
    if isinstance(n, str):
        return collapse(n)
    if n.name in DROPPED:
        return ""
    inner = "".join(_inline(c) for c in n.children)
    core = inner.strip()
    wrap = {"strong": "**", "b": "**", "em": "_", "i": "_", "del": "~", "s": "~", "strike": "~"}.get(n.name)
    if wrap:
        return inner.replace(core, f"{wrap}{core}{wrap}", 1) if core else inner
    if n.name == "code":
        return f"`{n.text()}`"
    if n.name == "br":
        return "  \n"
    if n.name == "img":
        return f"![{n.attrs.get('alt', '')}]({n.attrs['src']})" if n.attrs.get("src") else ""
    if n.name == "a" and n.attrs.get("href"):
        return f"[{core}]({n.attrs['href']})" if core else ""
    if n.name == "input" and n.attrs.get("type") == "checkbox":
        return "[x] " if "checked" in n.attrs else "[ ] "
    return inner


BLOCK = frozenset("p div section article main ul ol li table blockquote pre hr h1 h2 h3 h4 h5 h6 figure figcaption body html tbody thead tr td th dl dt dd address details summary form fieldset".split())


def _blocks(n: Node) -> str:
    if n.name in DROPPED:
        return ""
    if n.name in HEADS:
        inner = "".join(_inline(c) for c in n.children).strip()
        return f"\n\n{HEADS[n.name]}{inner}\n\n" if inner else ""
    if n.name == "pre":
        code = first(n, "code")
        lang = next((c[9:] for c in (code.classes() if code else []) if c.startswith("language-")), "")
        return f"\n\n```{lang}\n{n.text().strip(chr(10))}\n```\n\n"
    if n.name == "hr":
        return "\n\n* * *\n\n"
    if n.name in ("ul", "ol"):
        items = [c for c in n.elements() if c.name == "li"]
        begin = whole(n.attrs.get("start"), 1)
        lines = []
        for k, li in enumerate(items):
            mark = "-   " if n.name == "ul" else f"{begin + k}.  "
            body = re.sub(r"\n{2,}", "\n", _mixed(li).strip()).replace("\n", "\n    ")
            lines.append(mark + body)
        return "\n\n" + "\n".join(lines) + "\n\n"
    if n.name == "table":
        return _table(n)
    if n.name == "blockquote":
        inner = re.sub(r"\n{3,}", "\n\n", _mixed(n)).strip()
        return "\n\n" + "\n".join(f"> {x}".rstrip() for x in inner.split("\n")) + "\n\n"
    inner = _mixed(n)
    return f"\n\n{inner.strip()}\n\n" if n.name in BLOCK else inner


def _mixed(n: Node) -> str:
    out, run = [], []

    def flush() -> None:
        line = re.sub(r" *\n *", lambda m: "  \n" if m[0].startswith("  ") else "\n", "".join(run))
        if line.strip():
            out.append(line.strip(" ") if not out else line)
        run.clear()

    for c in n.children:
        if isinstance(c, Node) and (c.name in BLOCK or any(isinstance(d, Node) and d.name in BLOCK for d in c.walk())):
            flush()
            out.append(_blocks(c))
        else:
            run.append(_inline(c))
    flush()
    return "".join(out)


def _table(n: Node) -> str:
    rows = [[collapse(_inline(c)).strip().replace("|", "\\|") for c in r.elements() if c.name in ("td", "th")] for r in select(n, "tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    wide = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
    lines.insert(1, "|" + " --- |" * wide)
    return "\n\n" + "\n".join(lines) + "\n\n"


def to_markdown(html: str) -> str:
    return markdown(cleaned(parse(html)))


COMPACT = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def json_ld(root: Node, scripts: Iterable[Node] | None = None) -> list[str]:
    out = []
    for n in matching(root, 'script[type="application/ld+json"]', root.walk() if scripts is None else scripts):
        try:
            got = json.loads(n.text())
        except ValueError:
            continue
        out += [COMPACT(x) for x in (got if isinstance(got, list) else [got])]
    return out


def meta_tags(root: Node, prefix: str, metas: Iterable[Node] | None = None) -> dict[str, str]:
    """The last of each; empty contents are left out."""
    out = {}
    for n in matching(root, f'meta[property^="{prefix}"], meta[name^="{prefix}"]', root.walk() if metas is None else metas):
        key, value = n.attrs.get("property") or n.attrs.get("name"), n.attrs.get("content")
        if key and value:
            out[key] = value
    return out


def microdata(root: Node, every: Iterable[Node] | None = None) -> list[dict[str, list[str]]]:
    out = []
    for scope in matching(root, "[itemscope]", root.walk() if every is None else every):
        up = scope.parent
        while up is not None and "itemscope" not in up.attrs:
            up = up.parent
        if up is not None:
            continue
        found: dict[str, list[str]] = defaultdict(list)
        if scope.attrs.get("itemtype"):
            found["@type"].append(scope.attrs["itemtype"])
        for n in select(scope, "[itemprop]"):
            value = n.attrs.get(VALUE_OF.get(n.name, ""), None)
            found[n.attrs["itemprop"]].append(value if value is not None else n.text().strip())
        out.append(dict(found))
    return out


def by_name(root: Node) -> dict[str, list[Node]]:
    """Elements below ``root`` by name, each in document order."""
    out: dict[str, list[Node]] = {}
    for n in root.walk():
        out.setdefault(n.name, []).append(n)
    return out


def page_meta(root: Node, named: dict[str, list[Node]] | None = None) -> dict[str, str]:
    named = by_name(root) if named is None else named

    def content(name: str, test: str, attr: str = "content") -> str:
        n = first(root, name + test, named.get(name, ()))
        return (n.attrs.get(attr) or "") if n else ""

    title = next(iter(named.get("title", ())), None)
    return {
        "title": title.text() if title else "", "description": content("meta", '[name="description"]'), "canonical": content("link", '[rel="canonical"]', "href"),
        "language": content("html", "", "lang"), "author": content("meta", '[name="author"]'),
    }


#: what is read from a page's tree and its elements by name, each alone
STRUCTURED = {
    "json_ld": lambda root, named: json_ld(root, named.get("script", ())),
    "open_graph": lambda root, named: meta_tags(root, "og:", named.get("meta", ())),
    "twitter_cards": lambda root, named: meta_tags(root, "twitter:", named.get("meta", ())),
    "microdata": lambda root, named: [COMPACT(x) for x in microdata(root)],
    "meta": page_meta,
}


def structured(html: str, parts: Iterable[str] = tuple(STRUCTURED)) -> dict:
    """Those ``parts`` of a page's structured data, all of them unless some are named."""
    root = parse(html)
    named = by_name(root)
    return {k: STRUCTURED[k](root, named) for k in parts}


def field_of(item: Node, spec: str, joined: bool = False) -> str:
    """``sel``, ``sel @attr``, ``sel | attr`` or ``@attr`` below ``item``; an empty selector is the item itself."""
    if "|" in spec and "|=" not in spec:
        selector, attr = (x.strip() for x in spec.rsplit("|", 1))
    elif spec.startswith("@"):
        selector, attr = "", spec[1:].strip()
    elif " @" in spec:
        selector, attr = (x.strip() for x in spec.rsplit(" @", 1))
    else:
        selector, attr = spec.strip(), ""
    if not selector:
        found = [item]
    elif joined and not attr:
        found = select(item, selector)
    else:
        found = [n] if (n := first(item, selector)) else []
    if not found:
        return ""
    if attr:
        return found[0].attrs.get(attr, "")
    return "".join(n.text() for n in found).strip() if joined else found[0].text().strip()


def items(html: str, selector: str, fields: dict[str, str]) -> list[dict[str, str]]:
    return [{k: field_of(n, s) for k, s in fields.items()} for n in select(parse(html), selector)]


def single(html: str, fields: dict[str, str]) -> dict[str, str]:
    root = parse(html)
    return {k: field_of(root, s, joined=True) for k, s in fields.items()}


def page(html: str, selector: str, fields: dict[str, str], own: dict[str, str]) -> dict:
    """``items`` and ``single`` of a page that is parsed once."""
    root = parse(html)
    return {
        "items": [{k: field_of(n, s) for k, s in fields.items()} for n in select(root, selector)],
        "item": {k: field_of(root, s, joined=True) for k, s in own.items()},
    }


def pager(html: str) -> str | None:
    root = parse(html)
    return next((s for s in PAGERS if first(root, s)), None)


def signature(n: Node) -> str:
    return "|".join(".".join([c.name, *sorted(c.classes())]) for c in n.elements())


def fields_in(sample: Node) -> dict[str, str]:
    out: dict[str, str] = {}
    for h in ("h1", "h2", "h3", "h4"):
        if n := first(sample, h):
            linked = first(n, "a") is not None
            out["title"] = f"{h} a" if linked else h
            if linked:
                out["url"] = f"{h} a @href"
            break
    if "url" not in out and first(sample, "a"):
        out.setdefault("title", "a")
        out["url"] = "a @href"
    for name, selector, shown in (("date", "time", "time @datetime"), ("image", "img", "img @src"), ("summary", "p", "p")):
        if first(sample, selector):
            out[name] = shown
    for selector in ("[class*='author']", "[class*='byline']", "[rel='author']"):
        if n := first(sample, selector):
            out["author"] = f".{n.classes()[0]}" if n.classes() else selector
            break
    return out


def points_of(fields: dict[str, str]) -> int:
    return 10 * len(fields) + sum(points for k, points in (("title", 20), ("url", 15), ("date", 5), ("summary", 5)) if k in fields)


def marked(html: str) -> dict[str, list[Node]]:
    """Elements with classes by selector, in order."""
    groups: dict[str, list[Node]] = {}
    for n in parse(html).walk():
        if n.classes():
            groups.setdefault(".".join([n.name, *n.classes()]), []).append(n)
    return groups


def pattern_parts(html: str) -> list[dict]:
    """What a page adds to the patterns of its listing: elements by selector and mark, with the fields of each selector's first."""
    out = []
    for place, (selector, nodes) in enumerate(marked(html).items()):
        fields, counts = fields_in(nodes[0]), Counter(map(signature, nodes))
        for k, (mark, n) in enumerate(counts.items()):
            own = json.dumps(fields, sort_keys=True) if not k and fields else None
            out.append({"selector": selector, "mark": mark, "n": n, "place": place, "turn": k, "fields": own, "points": points_of(fields)})
    return out


def patterns(html: str, least: int = 3) -> list[dict]:
    """Repeated elements, best first: selector, fields, count, score."""
    groups = marked(html)
    out = []
    for selector, nodes in groups.items():
        if len(nodes) < least:
            continue
        marks = [signature(n) for n in nodes]
        if marks.count(marks[0]) * 2 < len(marks):
            continue
        fields = fields_in(nodes[0])
        if not fields:
            continue
        out.append({"selector": selector, "fields": fields, "count": len(nodes), "score": points_of(fields) + len(nodes)})
    return sorted(out, key=lambda p: -p["score"])


def media(html: str, base: str) -> list[tuple[str, str]]:
    """(kind, absolute URL) of images and videos, each URL once, in order."""
    root, seen, out = parse(html), set(), []

    def add(kind: str, url: str | None) -> None:
        if not url or url.startswith("data:"):
            return
        full = urljoin(base, url.strip())
        if full not in seen:
            seen.add(full)
            out.append((kind, full))

    for n in select(root, 'meta[property="og:image"], meta[name="twitter:image"]'):
        add("image", n.attrs.get("content"))
    for n in select(root, "img"):
        add("image", n.attrs.get("src") or n.attrs.get("data-src") or n.attrs.get("data-lazy-src"))
        for part in n.attrs.get("srcset", "").split(","):
            add("image", part.strip().split(" ")[0] if part.strip() else None)
    for n in select(root, "picture source"):
        for part in n.attrs.get("srcset", "").split(","):
            add("image", part.strip().split(" ")[0] if part.strip() else None)
    for n in select(root, "[style]"):
        for m in re.finditer(r"background(?:-image)?\s*:[^;]*url\(['\"]?([^'\")]+)", n.attrs["style"]):
            add("image", m[1])
    for n in select(root, "video, video source"):
        add("video", n.attrs.get("src"))
    return out


# What a URL of an image ends with, and the keys of structured data that hold images.
IMAGE_ENDS = r"\.(?:jpg|jpeg|png|gif|webp|svg|avif|bmp)"
IMAGE_KEYS = ("image", "images", "thumbnailUrl")
BACKGROUND = re.compile(r"""background-image\s*:\s*url\(["']?([^"')]+)["']?\)""", re.I)
IMAGE_URL = re.compile(rf"^https?://.*{IMAGE_ENDS}(?:\?|$)", re.I | re.S)
IMAGE_IN_TEXT = re.compile(rf"""https?://[^\s"'<>]+{IMAGE_ENDS}(?:\?[^\s"'<>]*)?""", re.I)
LAZY = ("src", "data-src", "data-lazy-src")


def _srcset(text: str) -> list[str]:
    return [part.split()[0] for part in text.split(",") if part.strip()]


def _selector(n: Node) -> str:
    return f"#{n.attrs['id']}" if n.attrs.get("id") else ".".join((n.name, *n.classes()))


def _stated_images(data) -> list[tuple[str, str]]:
    """(URL, name) of the images that a JSON-LD value names, level by level."""
    found, todo = [], [data]
    while todo:
        v = todo.pop(0)
        if isinstance(v, str) and IMAGE_URL.match(v):
            found.append((v, ""))
        elif isinstance(v, list):
            todo[:0] = v
        elif isinstance(v, dict):
            content = v.get("contentUrl")
            if isinstance(content, str) and re.search(IMAGE_ENDS + r"(?:\?|$)", content, re.I):
                found.append((content, str(v.get("name") or "")))
            found += [(x, "") for x in v.values() if isinstance(x, str) and IMAGE_URL.match(x)]
            todo[:0] = [v[k] for k in IMAGE_KEYS if v.get(k)]
    return found


def images(html: str, base: str) -> list[dict]:
    """url, alt, width, height, selector and source of a page's images, as far as they can be found without a browser.

    Sources, in this order: img, picture, background-inline, background-css, jsonld, inline-script; a URL counts once. The
    sizes are those that the page states, 0 where it states none.
    """
    root = parse(html)
    found: dict[str, dict] = {}

    def add(url: str | None, source: str, selector: str, n: Node | None = None, alt: str = "") -> None:
        if url and url not in found:
            size = {k: whole(n.attrs.get(k), 0) if n is not None else 0 for k in ("width", "height")}
            found[url] = {"url": url, "alt": n.attrs.get("alt", "") if n is not None else alt, **size, "selector": selector, "source": source}

    def full(href: str | None) -> str | None:
        if not href or href.startswith("data:"):
            return None
        try:
            return urljoin(base, href.strip())
        except ValueError:
            return None

    for n in select(root, "img"):
        shown = next((n.attrs[k] for k in LAZY if n.attrs.get(k)), None)
        for href in (shown, *_srcset(n.attrs.get("srcset") or n.attrs.get("data-srcset", ""))):
            add(full(href), "img", _selector(n), n)
    for n in select(root, "picture source"):
        top = n
        while top.name != "picture":
            top = top.parent
        for href in _srcset(n.attrs.get("srcset") or n.attrs.get("data-srcset", "")):
            add(full(href), "picture", _selector(top))
    for n in select(root, "[style]"):
        if m := BACKGROUND.search(n.attrs["style"]):
            add(full(m[1]), "background-inline", _selector(n))
    for n in select(root, "style"):
        for m in BACKGROUND.finditer(n.text()):
            add(full(m[1]), "background-css", "<style>")
    for n in select(root, 'script[type="application/ld+json"]'):
        try:
            stated = _stated_images(json.loads(n.text() or "{}"))
        except (ValueError, RecursionError):
            stated = []
        for url, name in stated:
            add(url, "jsonld", "<json-ld>", alt=name)
    for n in select(root, "script"):
        if "src" not in n.attrs:
            for m in IMAGE_IN_TEXT.finditer(n.text()):
                add(m[0], "inline-script", "<inline-script>")
    return list(found.values())


# Class and id words for and against article text.
AGAINST = re.compile(r"banner|breadcrumb|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup|newsletter", re.I)
FOR = re.compile(r"article|body|column|content|main|shadow|post|text|story|entry", re.I)


def readable(root: Node, least: float = 20, size: int = 140) -> bool:
    """Whether enough long paragraphs are there for an article; blocks broken by br count as paragraphs, those of lists don't."""
    score = 0.0
    broken = {id(b.parent): b.parent for b in select(root, "div > br")}
    listed = {id(p) for p in select(root, "li p")}
    for n in [*(p for p in select(root, "p, pre, article") if id(p) not in listed), *broken.values()]:
        mark = " ".join((n.attrs.get("class", ""), n.attrs.get("id", "")))
        if AGAINST.search(mark) and not FOR.search(mark):
            continue
        length = len(n.text().strip())
        if length >= size:
            score += (length - size) ** 0.5
            if score > least:
                return True
    return False


def article(html: str, gate: bool = True) -> dict[str, str] | None:
    """title, byline, published and Markdown content of a page's article, by scoring paragraphs for their ancestors."""
    root = parse(html)
    if gate and not readable(root):
        return None
    meta, og = page_meta(root), meta_tags(root, "og:")
    published = meta_tags(root, "article:").get("article:published_time", "")
    by = first(root, "[rel='author'], [class*='byline'], [itemprop='author']")
    h1 = first(root, "h1")
    cleaned(root)
    scores: dict[int, float] = defaultdict(float)
    nodes: dict[int, Node] = {}
    for p in select(root, "p, pre, td, blockquote"):
        text = p.text().strip()
        if len(text) < 25:
            continue
        points = 1 + text.count(",") + min(len(text) // 100, 3)
        for n, share in ((p.parent, 1.0), (p.parent.parent if p.parent else None, 0.5)):
            if n is None or n.name == "#document":
                continue
            if id(n) not in nodes:
                nodes[id(n)] = n
                mark = " ".join((n.attrs.get("class", ""), n.attrs.get("id", "")))
                scores[id(n)] += (25 if FOR.search(mark) or n.name in ("article", "main") else 0) - (25 if AGAINST.search(mark) else 0)
            scores[id(n)] += points * share

    def worth(k: int) -> float:
        whole = len(nodes[k].text()) or 1
        linked = sum(len(a.text()) for a in select(nodes[k], "a"))
        return scores[k] * (1 - linked / whole)

    if not nodes:
        return None
    best = nodes[max(nodes, key=worth)]
    content = markdown(best)
    if len(content) < 50:
        return None
    return {
        "title": og.get("og:title") or (h1.text().strip() if h1 else "") or meta["title"], "byline": meta["author"] or (by.text().strip() if by else ""),
        "published": published, "site_name": og.get("og:site_name", ""), "content": content,
    }


def script_json(html: str, name: str) -> str | None:
    """JSON of ``<script id=name>``, or the object that ``name`` is assigned in a script, by balanced braces."""
    root = parse(html)
    n = first(root, f"script[id='{name}']") if re.fullmatch(r"[\w-]+", name) else None
    texts = [n.text()] if n else []
    for s in select(root, "script"):
        if m := re.search(rf"(?:var\s+|let\s+|const\s+|window\.)?{re.escape(name)}\s*=\s*|window\[['\"]{re.escape(name)}['\"]\]\s*=\s*", s.text()):
            texts.append(balanced(s.text()[m.end() :]) or "")
    for t in texts:
        try:
            return json.dumps(json.loads(t), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            continue
    return None


def balanced(text: str) -> str | None:
    """The leading JSON object or array of a text."""
    depth, quoted, k = 0, False, 0
    while k < len(text):
        c = text[k]
        if quoted:
            if c == "\\":
                k += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth <= 0:
                return text[: k + 1]
        elif depth == 0 and not c.isspace():
            return None
        k += 1
    return None


def recovered_json(text: str) -> str | None:
    """JSON out of a model's answer: the text, a fenced block, or what starts at the first bracket, shrinking from the end."""
    tries = [text, *(m[1] for m in re.finditer(r"```(?:json)?\s*(.*?)```", text, re.S))]
    for t in tries:
        try:
            return json.dumps(json.loads(t), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            continue
    m = re.search(r"[\[{]", text)
    if m:
        tail = text[m.start() :]
        for e in [k for k in range(len(tail), 0, -1) if tail[k - 1] in "]}"]:
            try:
                return json.dumps(json.loads(tail[:e]), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                continue
    return None
