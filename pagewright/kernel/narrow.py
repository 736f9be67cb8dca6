"""Narrowing a page: selecting and removing elements, inventories, text, cleaning and the main content by scores."""

from __future__ import annotations

import re

from pagewright.kernel.css import select
from pagewright.kernel.tree import BLOCK, Node, parse_html
from pagewright.kernel.url import resolve

_NO_TEXT = frozenset(["script", "style", "link", "svg", "noscript", "template"])
#: Shapes of utility classes, as frameworks of such classes write them.
_UTILITY = re.compile(
    r"^!?-?(?:(?:sm|md|lg|xl|2xl|hover|focus|active|dark|group-hover|first|last|odd|even|disabled|print)[:-])*!?-?"
    r"(?:[mp][trblxyse]?|w|h|min-[wh]|max-[wh]|size|gap|space-[xy]|inset(?:-[xy])?|top|right|bottom|left|z|order|col|row|grid|flex|basis|grow|shrink|items|justify|content|self|place|float|clear|object|overflow|overscroll"
    r"|text|font|leading|tracking|list|decoration|underline|align|whitespace|break|bg|from|via|to|border|rounded|divide|outline|ring|shadow|opacity|mix|blur|filter|backdrop|transition|duration|ease|delay|animate|scale|rotate"
    r"|translate|skew|origin|cursor|select|resize|scroll|snap|touch|will|fill|stroke|sr|aspect|columns|table|caption)(?:-[\w./%\[\]#]+)+$|^(?:border|rounded|shadow|outline|ring|underline|transition|resize|blur|filter|grow|shrink|block|inline|hidden|visible|static|fixed|absolute|relative|sticky|flex|grid|italic|uppercase|lowercase|capitalize|truncate|container|antialiased)$"
)


def narrow(root: Node, target: list[str] | None = None, remove: list[str] | None = None) -> Node | None:
    """The tree without what `remove` selects, or the parts of it that `target` selects; None if there are none."""
    for svg in [n for n in root.elements() if n.tag == "svg"]:
        svg.children = []
    for selector in remove or []:
        for node in select(root, selector):
            node.remove()
    if not target:
        return root
    chosen: list[Node] = []
    for selector in target:
        chosen += [n for n in select(root, selector) if not any(n is c for c in chosen)]
    if not chosen:
        return None
    body = Node("body")
    for i, node in enumerate(chosen):
        node.remove()
        if i:
            body.append(Node(None, text="\n\n"))
        body.append(node)
    old = root.find("html")
    page = Node("html")
    if old is not None:
        page.attrs = dict(old.attrs)
    if (head := root.find("head")) is not None:
        head.remove()
        page.append(head)
    page.append(body)
    out = Node("#root")
    out.append(page)
    return out


def metadata(root: Node) -> dict[str, list[str]]:
    """Contents of the page's meta elements by name or property, and its language."""
    out: dict[str, list[str]] = {}
    page = root.find("html")
    if page is not None and page.attrs.get("lang"):
        out["lang"] = [page.attrs["lang"]]
    for n in root.elements():
        if n.tag == "meta" and "content" in n.attrs:
            key = n.attrs.get("name") or n.attrs.get("property")
            if key:
                out.setdefault(key, []).append(n.attrs["content"])
    return out


def external_links(root: Node, base: str) -> dict[str, dict[str, dict[str, str]]]:
    """rel, address and attributes of the head's links, without style sheets."""
    out: dict[str, dict[str, dict[str, str]]] = {}
    for n in root.elements():
        if n.tag == "link" and n.attrs.get("rel") and n.attrs.get("href") and (href := resolve(n.attrs["href"], base)):
            rest = {k: v for k, v in n.attrs.items() if k not in ("rel", "href")}
            for rel in n.attrs["rel"].split():
                if rel.lower() not in ("stylesheet", "shortcut"):
                    out.setdefault(rel, {}).setdefault(href, {}).update(rest)
    return out


def inner_text(node: Node) -> str:
    """Text as it reads: white space collapsed, a line for each block, nothing of scripts and styles."""
    parts: list[str] = []

    def walk(n: Node) -> None:
        if n.tag is None:
            parts.append(re.sub(r"\s+", " ", n.text))
            return
        if n.tag[0] == "#" and n.tag != "#root" or n.tag in _NO_TEXT or n.tag in ("head", "title"):
            return
        line = n.tag in BLOCK or n.tag == "br"
        if line:
            parts.append("\n")
        for c in n.children:
            walk(c)
        if n.tag in ("td", "th"):
            parts.append("\t")
        elif line:
            parts.append("\n")

    walk(node)
    lines = [re.sub(r" +", " ", x).strip() for x in "".join(parts).split("\n")]
    return "\n".join(x for x in lines if x)


def title_of(root: Node) -> str | None:
    node = root.find("title")
    text = re.sub(r"[ \t\n\r\f]+", " ", node.raw_text()).strip(" ") if node is not None else ""
    return text or None


def description_of(root: Node) -> str | None:
    for n in root.elements():
        if n.tag == "meta" and (n.attrs.get("name", "").endswith("description") or n.attrs.get("property", "").endswith("description")):
            return n.attrs.get("content") or None
    return None


def link_inventory(root: Node, base: str) -> list[tuple[str, str]]:
    """(text, address) of every link in document order; addresses that can't be read are left out."""
    out = []
    for n in root.elements():
        if n.tag == "a" and n.attrs.get("href") and (href := resolve(n.attrs["href"], base)):
            out.append((re.sub(r"\s+", " ", n.raw_text()).strip(), href))
    return out


def image_inventory(root: Node, base: str) -> list[dict]:
    """src, alt, width and height of every image; a deferred address stands in for an inline one."""
    out = []
    for n in root.elements():
        if n.tag != "img":
            continue
        src = n.attrs.get("src", "")
        if not src or src.startswith("data:"):
            later = n.attrs.get("data-src", "")
            src = later if later and not later.startswith("data:") else src
        if src and (url := src if src.startswith("data:") else resolve(src, base)):
            size = {k: int(m[0]) if (m := re.match(r"\d+", n.attrs.get(k, ""))) else None for k in ("width", "height")}
            out.append({"src": url, "alt": n.attrs.get("alt") or n.attrs.get("title") or None, **size})
    return out


def clean_for_lm(html: str, remove: list[str] | None = None) -> str:
    """HTML with what tells a language model nothing left out: comments, styles, utility classes, data attributes, inline data."""
    root = narrow(parse_html(html), None, remove)
    for n in list(root.walk()):
        if n.tag == "#comment":
            n.remove()
            continue
        if n.tag is None:
            continue
        attrs = {}
        for k, v in n.attrs.items():
            if k.startswith(("data-", "aria-")) or k == "srcset":
                continue
            if k == "class":
                v = " ".join(c for c in v.split() if not _UTILITY.match(c))
                if not v:
                    continue
            if k == "style":
                m = re.match(r"\s*display:\s*none\s*;?", v)
                if not m:
                    continue
                v = "display: none"
            attrs[k] = "blob:opaque" if k in ("src", "href") and v.startswith("data:") else v
        n.attrs = attrs
    return squeeze_lines(root.outer_html())


def squeeze_lines(text: str) -> str:
    """Blank lines only behind lines that aren't."""
    lines = text.split("\n")
    return "\n".join(x for i, x in enumerate(lines) if x.strip() or (i and lines[i - 1].strip()))


# Main content by scores, after the published descriptions of reader views.

_UNLIKELY = re.compile(r"-ad-|banner|breadcrumb|combx|comment|community|cookie|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|meta|related|remark|replies|rss|share|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup|promo|newsletter|nav", re.I)
_LIKELY = re.compile(r"and|article|body|column|content|main|shadow|post|entry|text", re.I)
_POSITIVE = re.compile(r"article|body|content|entry|hentry|h-entry|main|page|post|text|blog|story", re.I)
_NEGATIVE = re.compile(r"-ad-|hidden|banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget|newsletter", re.I)
_PARAGRAPHS = frozenset(["p", "td", "pre", "section", "h2", "h3", "h4", "h5", "h6", "blockquote", "li"])


def _weight(n: Node) -> int:
    name = f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}"
    return 25 * bool(_POSITIVE.search(name)) - 25 * bool(_NEGATIVE.search(name))


def _link_density(n: Node) -> float:
    whole = len(n.raw_text().strip())
    return sum(len(a.raw_text()) for a in n.elements() if a.tag == "a") / whole if whole else 0.0


def readable(html: str) -> dict | None:
    """title, byline, lang, content (HTML), text, length and excerpt of the page's main content; None if there is too little."""
    root = parse_html(html)
    page, title = root.find("html"), title_of(root)
    meta = metadata(root)
    body = root.find("body") or page
    for n in list(body.elements()):
        name = f"{n.attrs.get('class', '')} {n.attrs.get('id', '')} {n.attrs.get('role', '')}"
        if n.tag in ("script", "style", "noscript", "nav", "aside", "footer", "form", "button", "iframe", "svg", "template") or (
            n.tag not in ("html", "body", "article", "main", "a") and _UNLIKELY.search(name) and not _LIKELY.search(name)
        ):
            n.remove()
    scores: dict[int, float] = {}
    held: dict[int, Node] = {}
    for n in body.elements():
        if n.tag not in _PARAGRAPHS:
            continue
        text = n.raw_text().strip()
        if len(text) < 25:
            continue
        points = 1 + len(re.findall(r"[,،、，;；]", text)) + min(3, len(text) // 100)
        up, level = n.parent, 0
        while up is not None and up.tag != "#root" and level < 3:
            if id(up) not in scores:
                base = {"div": 5, "article": 10, "main": 8, "section": 3, "pre": 3, "td": 3, "blockquote": 3, "form": -3, "ul": -3, "ol": -3, "dl": -3, "h1": -5, "h2": -5, "th": -5}.get(up.tag, 0)
                scores[id(up)], held[id(up)] = base + _weight(up), up
            scores[id(up)] += points / (1, 2, 6)[level]
            up, level = up.parent, level + 1
    if not scores:
        return None
    final = {k: v * (1 - _link_density(held[k])) for k, v in scores.items()}
    best = max(final, key=lambda k: final[k])
    top = held[best]
    parts = [top]
    if top.parent is not None and top.parent.tag != "#root":
        limit = max(10, final[best] * 0.2)
        for kin in top.parent.children:
            if kin is top or kin.tag is None or kin.tag[0] == "#":
                continue
            text = kin.raw_text().strip()
            if final.get(id(kin), 0) >= limit or (kin.tag == "p" and len(text) > 80 and _link_density(kin) < 0.25):
                parts.append(kin)
        order = {id(c): i for i, c in enumerate(top.parent.children)}
        parts.sort(key=lambda c: order[id(c)])
    content = "".join(p.outer_html() for p in parts)
    text = "\n".join(inner_text(p) for p in parts)
    if len(text) < 40:
        return None
    first = next((p.raw_text().strip() for c in parts for p in c.elements() if p.tag == "p" and p.raw_text().strip()), text)
    return {
        "title": title, "byline": next(iter(meta.get("author", [])), None), "lang": page.attrs.get("lang") if page is not None else None, "content": content, "text": text, "length": len(text),
        "excerpt": next(iter(meta.get("description", [])), first[:200]), "published_time": next(iter(meta.get("article:published_time", [])), None),
    }
