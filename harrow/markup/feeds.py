"""Site maps, feeds and robots rules."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from harrow.markup.dom import parse, select, unescape, without_tags


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _root(xml: str):
    if "<!DOCTYPE" in xml or "<!ENTITY" in xml:
        return None  # entities can be made to grow without bound
    try:
        return ET.fromstring(xml)
    except ET.ParseError:
        return None


def sitemap(xml: str) -> list[str]:
    """Places of pages, then of further site maps; nothing is followed."""
    root = _root(xml)
    if root is None:
        return [unescape(x.split("</loc>", 1)[0].strip()) for x in xml.split("<loc>")[1:] if "</loc>" in x]
    out = []
    for kind in ("url", "sitemap"):
        for n in root.iter():
            if _local(n.tag) == kind:
                out += [(c.text or "").strip() for c in n if _local(c.tag) == "loc" and (c.text or "").strip()]
    return out


def entries(xml: str, summary: int = 500) -> list[dict]:
    """Items of an RSS or Atom feed."""
    root = _root(xml)
    out = []
    for n in root.iter() if root is not None else ():
        if _local(n.tag) not in ("item", "entry"):
            continue
        text: dict[str, str] = {}
        categories, image, link, alternate = [], None, None, None
        for c in n:
            name, value = _local(c.tag), (c.text or "").strip()
            if name == "category":
                categories.append(value or c.get("term") or "")
            elif name == "link":
                href = value or c.get("href") or ""
                link = link or href
                alternate = alternate or (href if c.get("rel") in (None, "alternate") else None)
            elif name == "author":
                text.setdefault("author", value or next((x.text or "" for x in c if _local(x.tag) == "name"), ""))
            else:
                text.setdefault("content" if name == "encoded" else name, value)
        urls = {_local(c.tag): c.get("url") for c in n if c.get("url")}
        image = urls.get("enclosure") or ("content" in urls and urls["content"]) or urls.get("thumbnail")
        if not image:
            image = next((i.attrs["src"] for i in select(parse(text.get("content") or text.get("description") or ""), "img") if i.attrs.get("src")), None)
        plain = without_tags(text.get("summary") or text.get("description") or text.get("content") or "").strip()
        out.append({
            "title": text.get("title") or "(untitled)", "link": alternate or link or "", "published": text.get("pubDate") or text.get("published") or text.get("updated") or text.get("date"),
            "creator": text.get("creator") or text.get("author"), "summary": plain[:summary], "categories": categories, "image": image or None,
        })
    return out


def rules(robots: str, agent: str) -> list[tuple[bool, str]]:
    """(allow, path) of the group for ``agent``, else of the group for all."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    named: list[str] = []
    last_was_rule = True
    for line in robots.splitlines():
        line = line.split("#", 1)[0].strip()
        if ":" not in line:
            continue
        key, value = (x.strip() for x in line.split(":", 1))
        key = key.lower()
        if key == "user-agent":
            named = [value.lower()] if last_was_rule else [*named, value.lower()]
            last_was_rule = False
            groups.setdefault(value.lower(), [])
        elif key in ("allow", "disallow"):
            last_was_rule = True
            for g in named:
                if value:
                    groups[g].append((key == "allow", value))
    own = [g for g in groups if g != "*" and g in agent.lower()]
    return groups[max(own, key=len)] if own else groups.get("*", [])


def matches(pattern: str, path: str) -> bool:
    """Whether a rule's path, with * for anything and $ at the end, is a prefix of ``path``. Parts are looked for in order, so time is linear."""
    bound = pattern.endswith("$")
    first, *rest = pattern.removesuffix("$").split("*")
    if not path.startswith(first):
        return False
    at = len(first)
    if not rest:
        return not bound or at == len(path)
    for part in rest[:-1] if bound else rest:
        if (found := path.find(part, at)) < 0:
            return False
        at = found + len(part)
    return not bound or (path.endswith(rest[-1]) and len(path) - len(rest[-1]) >= at)


def allowed(robots: str, path: str, agent: str = "*") -> bool:
    """The longest matching rule decides, an allowing one among equals; without one a path is allowed."""
    best = (-1, True)
    for allow, pattern in rules(robots, agent):
        if matches(pattern, path):
            best = max(best, (len(pattern), allow))
    return best[1]


def sitemaps(robots: str) -> list[str]:
    return re.findall(r"(?im)^\s*sitemap\s*:\s*(\S+)", robots)
