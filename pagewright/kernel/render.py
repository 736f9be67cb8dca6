"""Markdown from a page's tree: one rule for each element, folded from the leaves up."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from urllib.parse import urlsplit

from pagewright.kernel.tree import Node
from pagewright.kernel.url import resolve

Rule = Callable[[str, Node, "Renderer"], str]


@dataclass(frozen=True)
class RenderOptions:
    """How a page is rendered. Retention: links none, all, text or gpt-oss; images none, all, alt, all_p or alt_p; media none, text, link, image or html."""

    base: str = ""
    heading_style: str = "atx"
    hr: str = "* * *"
    bullet: str = "*"
    em: str = "_"
    strong: str = "**"
    link_style: str = "inlined"
    link_reference: str = "full"
    code_style: str = "fenced"
    fence: str = "```"
    gfm: bool | str = True
    links: str | None = None
    images: str | None = None
    media: str | None = None
    keep_data_urls: bool = False
    drop_irrelevant: bool = False
    omit_head: bool = False
    keep: frozenset[str] = frozenset()
    alts: dict[str, str] = field(default_factory=dict)
    rules: tuple[tuple[tuple[str, ...], Rule], ...] = ()


# Addresses of embedded players and the pages they show; those without one are their own.
VIDEO_HOSTS = [
    (re.compile(r"(?i)^(?:https?:)?//(?:www\.)?youtube(?:-nocookie)?\.com/embed/([\w-]+)"), "https://www.youtube.com/watch?v={}"),
    (re.compile(r"(?i)^(?:https?:)?//youtu\.be/([\w-]+)"), "https://www.youtube.com/watch?v={}"),
    (re.compile(r"(?i)^(?:https?:)?//player\.bilibili\.com/player\.html\?[^\"'\s]*?bvid=(BV[\w-]+)"), "https://www.bilibili.com/video/{}"),
    (re.compile(r"(?i)^((?:https?:)?//player\.bilibili\.com/player\.html\?.*)"), "{}"),
    (re.compile(r"(?i)^(?:https?:)?//player\.vimeo\.com/video/(\d+)"), "https://vimeo.com/{}"),
    (re.compile(r"(?i)^(?:https?:)?//(?:www\.)?dailymotion\.com/embed/video/([\w-]+)"), "https://www.dailymotion.com/video/{}"),
    (re.compile(r"(?i)^((?:https?:)?//player\.twitch\.tv/.*)"), "{}"),
    (re.compile(r"(?i)^((?:https?:)?//clips\.twitch\.tv/embed\?.*)"), "{}"),
    (re.compile(r"(?i)^((?:https?:)?//v\.qq\.com/.*)"), "{}"),
    (re.compile(r"(?i)^((?:https?:)?//(?:www\.)?tiktok\.com/embed.*)"), "{}"),
]
# Characters of a citation's own marks, and what they become in its text.
CITATION_ESCAPES = {"\u3010": "\u3016", "\u3011": "\u3017", "\u25fc": "\u25fe", "\u200b": "", "\u2020": "\u2021"}


def video_page(url: str | None) -> str | None:
    """The page of an embedded video; None for other addresses."""
    if not url:
        return None
    url = "https:" + url if url.startswith("//") else url
    for pattern, page in VIDEO_HOSTS:
        if m := pattern.match(url):
            return page.format(m[1])
    return None


def blob_url(data_url: str, base: str) -> str:
    """A short name for a data URL on the page's origin."""
    u = urlsplit(base or "")
    origin = f"{u.scheme}://{u.netloc}" if u.netloc else "null"
    return f"blob:{origin}/{hashlib.md5(data_url.encode()).hexdigest()}"


_SKIP = frozenset(["script", "meta", "style", "link"])
_IRRELEVANT = frozenset(["meta", "style", "script", "noscript", "link", "textarea", "select"])
_TABLE_TAGS = frozenset(["table", "thead", "tbody", "tfoot", "tr", "td", "th", "del", "s", "strike", "input", "math"])
_WORDISH = re.compile(r"[^\W]")
_BLOCKS = re.compile(r"\n{3,}")


class Renderer:
    """Renders one tree; keeps the ledgers of links, images and media in traversal order."""

    def __init__(self, options: RenderOptions | None = None) -> None:
        self.o = options or RenderOptions()
        self.links: list[dict] = []
        self.images: list[dict] = []
        self.serials = {"image": 0, "video": 0, "audio": 0}
        self.lists: list[dict] = []
        self.tables: list[dict] = []
        self.verbatim = 0
        self.in_item = 0

    def render(self, root: Node) -> str:
        out = _BLOCKS.sub("\n\n", self.node(root)).strip()
        if self.o.link_style == "referenced" and self.links:
            if self.o.link_reference == "full":
                lines = [f"[{x['ref']}]: {x['href']}" + (f' "{x["title"]}"' if x["title"] else "") for x in self.links]
            else:
                lines = [f"[{x['text']}]: {x['href']}" for x in self.links]
            out += "\n\n" + "\n".join(lines)
        return out

    def children(self, node: Node) -> str:
        out = ""
        for child in node.children:
            part = self.node(child)
            if not part:
                continue
            if out and not self.verbatim and _WORDISH.match(part[0]) and _WORDISH.match(out[-1]):
                out += " "  # words of adjacent elements stay apart
            out += part
        return out

    def node(self, node: Node) -> str:
        tag = node.tag
        if tag is None:
            return self.text(node)
        if tag == "#comment":
            return ""
        if tag in self.o.keep:
            return node.outer_html()
        if self.o.drop_irrelevant and tag in _IRRELEVANT or tag in _SKIP or tag == "head" and self.o.omit_head:
            return ""
        rule = None if tag in _TABLE_TAGS and not self.o.gfm else getattr(self, f"on_{_ALIAS.get(tag, tag)}", None)
        if tag == "table" and self.o.gfm == "table":
            out = f"\n\n{node.outer_html()}\n\n"
        else:
            out = rule(node) if rule else self.children(node)
        for tags, custom in self.o.rules:
            if tag in tags:
                out = custom(out, node, self)
        return out

    def text(self, node: Node) -> str:
        if self.verbatim:
            return node.text
        if not node.text.strip():
            return ""
        text = re.sub(r"\s+", " ", node.text)
        whole = text.strip()
        if re.fullmatch(r"\*\*.+\*\*|_.+_", whole):
            return f" {whole} "
        return text

    # headings, paragraphs and breaks

    def on_heading(self, node: Node) -> str:
        text, level = re.sub(r"\s*\n\s*", " ", self.children(node)).strip(), int(node.tag[1])
        if not text:
            return ""
        if self.o.heading_style == "setext" and level < 3:
            return f"\n{text}\n{('=' if level == 1 else '-') * len(text)}\n\n"
        return f"\n{'#' * level} {text}\n\n"

    def on_p(self, node: Node) -> str:
        text = self.children(node).strip()
        return f"\n{text}\n\n" if text else ""

    def on_br(self, node: Node) -> str:
        return "\n\n"

    def on_hr(self, node: Node) -> str:
        return f"\n\n{self.o.hr}\n\n"

    def on_title(self, node: Node) -> str:
        text = self.children(node).strip()
        if not text:
            return ""
        return f"\n# {text}\n\n" if self.o.drop_irrelevant else f"{text}\n"

    def on_figcaption(self, node: Node) -> str:
        text = self.children(node).strip()
        return f"\n\n{text}\n\n" if text else ""

    def on_div(self, node: Node) -> str:
        language = re.search(r"highlight-(?:text|source)-([\w-]+)", node.attrs.get("class", ""))
        first = next((c for c in node.children if c.tag), None)
        if language and first is not None and first.tag == "pre":
            return f"\n\n{self.o.fence}{language[1]}\n{first.raw_text().strip(chr(10))}\n{self.o.fence}\n\n"
        text = self.children(node).strip("\n")
        if not text.strip():
            return ""
        return f"{text} " if self.in_item else f"\n\n{text}\n\n"

    # inline

    def on_strong(self, node: Node) -> str:
        text = self.children(node).strip()
        return f"{self.o.strong}{text}{self.o.strong}" if text else ""

    def on_em(self, node: Node) -> str:
        text = self.children(node).strip()
        return f"{self.o.em}{text.replace('_', chr(92) + '_') if self.o.em == '_' else text}{self.o.em}" if text else ""

    def on_del(self, node: Node) -> str:
        text = self.children(node).strip()
        return f"~~{text}~~" if text else ""

    def on_a(self, node: Node) -> str:
        href = node.attrs.get("href")
        if self.o.links == "none":
            return ""
        text = re.sub(r"\s+", " ", self.children(node)).strip()
        if self.o.links == "text":
            return text if href else ""
        if self.o.link_style == "discarded":
            return text
        if not href:
            return f"[{text}]()"
        target = self.absolute(href)
        if self.o.links == "gpt-oss":
            return self.cited(text, target)
        title = re.sub(r"(\n+\s*)+", "\n", node.attrs.get("title", ""))
        mark = re.match(r"(#{1,6} )(.*)", text, re.S)
        lead, text = (mark[1], mark[2]) if mark else ("", text)
        ref = self.linked(text, target, title)
        quoted = title.replace('"', '\\"')
        if self.o.link_style == "referenced":
            tail = {"full": f"[{ref}]", "collapsed": "[]", "shortcut": ""}[self.o.link_reference]
            return f"{lead}[{text}]{tail}"
        return f"{lead}[{text}]({target}" + (f' "{quoted}"' if title else "") + ")"

    def cited(self, text: str, href: str) -> str:
        if re.match(r"(?i)(mailto|javascript):", href):
            return text
        ref, own, other = self.linked(text, href, ""), urlsplit(self.o.base).netloc, urlsplit(href).netloc
        clean = text.translate(str.maketrans(CITATION_ESCAPES))
        return f"【{ref}†{clean}" + (f"†{other}" if other and other != own else "") + "】"

    def linked(self, text: str, href: str, title: str) -> int:
        for x in self.links:
            if x["href"] == href and x["title"] == title:
                return x["ref"]
        self.links.append({"href": href, "text": text, "title": title, "ref": len(self.links) + 1})
        return len(self.links)

    def absolute(self, href: str) -> str:
        if self.o.base.startswith("blob:"):
            return href
        return (resolve(href, self.o.base) if self.o.base else None) or href

    # images and media

    def image_source(self, node: Node) -> str:
        src = node.attrs.get("src") or node.attrs.get("srcset", "").split(",")[0].strip().split(" ")[0] or node.attrs.get("data-src", "")
        if src.startswith("data:"):
            if not self.o.keep_data_urls and node.attrs.get("data-src", "data:")[:5] != "data:":
                return self.absolute(node.attrs["data-src"])
            return src if self.o.keep_data_urls else blob_url(src, self.o.base)
        return self.absolute(src) if src else ""

    def on_img(self, node: Node) -> str:
        src, mode = self.image_source(node), self.o.images
        alt = re.sub(r"(\n+\s*)+", "\n", self.o.alts.get(src) or node.attrs.get("alt", ""))
        title = node.attrs.get("title", "").replace('"', '\\"')
        if mode is None:
            if src:
                self.images.append({"src": src, "alt": alt, "ref": len(self.images) + 1})
            return f"![{alt}]({src}" + (f' "{title}"' if title else "") + ")" if src else ""
        if not src or mode == "none":
            return ""
        self.serials["image"] += 1
        n = self.serials["image"]
        self.images.append({"src": src, "alt": alt, "ref": n})
        if mode in ("alt", "alt_p"):
            label = f"Image {n}: {alt}" if mode == "alt_p" or alt else ""
            return f"({label.rstrip(': ')})" if label else ""
        return f"![Image {n}: {alt}]({src})" if alt else f"![Image {n}]({src})"

    def on_media(self, node: Node) -> str:
        mode = self.o.media
        if mode is None:
            return self.children(node)
        holders = [node, *(n for n in node.elements() if n.tag == "source")]
        src = next((v for n in holders for k in ("src", "srcset", "data-src") if (v := n.attrs.get(k, "").split(",")[0].strip().split(" ")[0])), "")
        if mode == "none" or not src:
            return ""
        return self.media(node.tag, self.absolute(src), node)

    def media(self, kind: str, url: str, node: Node) -> str:
        self.serials[kind] += 1
        label = f"{kind.title()} {self.serials[kind]}"
        mode = self.o.media
        if mode == "text":
            return f"({label})"
        if mode == "html":
            return f'\n\n<{node.tag} src="{url}"></{node.tag}>\n\n'
        if mode == "image":
            return f"![{label}]({url})"
        if self.o.link_style == "discarded":
            return label
        ref = self.linked(label, url, "")
        if self.o.link_style == "referenced":
            return f"[{label}]" + {"full": f"[{ref}]", "collapsed": "[]", "shortcut": ""}[self.o.link_reference]
        return f"[{label}]({url})"

    def on_iframe(self, node: Node) -> str:
        src = node.attrs.get("src") or node.attrs.get("href") or ""
        src = "https:" + src if src.startswith("//") else self.absolute(src) if src else ""
        page = video_page(src)
        if page is None or self.o.media is None:
            return self.children(node)
        if self.o.media == "none":
            return ""
        return self.media("video", src if self.o.media == "html" else page, node)

    def on_svg(self, node: Node) -> str:
        return ""

    # code

    def on_pre(self, node: Node) -> str:
        self.verbatim += 1
        out = self.children(node)
        self.verbatim -= 1
        return f"\n\n{out.strip(chr(10))}\n\n"

    def on_code(self, node: Node) -> str:
        text = node.raw_text()
        holder = " ".join([node.attrs.get("class", ""), node.parent.attrs.get("class", "") if node.parent is not None and node.parent.tag == "pre" else ""])
        language = re.search(r"(?:language|lang)-(\S+)", holder)
        if not language and "\n" not in text.strip("\n"):
            return f"`{text.strip()}`" if text.strip() else ""
        text = text.strip("\n")
        if self.o.code_style == "indented":
            return "\n\n" + "\n".join("    " + line for line in text.split("\n")) + "\n\n"
        return f"\n\n{self.o.fence}{language[1] if language else ''}\n{text}\n{self.o.fence}\n\n"

    # lists

    def on_list(self, node: Node) -> str:
        start = node.attrs.get("start", "")
        self.lists.append({"ordered": node.tag == "ol", "n": int(start) - 1 if start.lstrip("-").isdigit() else 0})
        out = self.children(node)
        self.lists.pop()
        return f"\n{out.strip(chr(10))}\n" if self.lists else f"\n\n{out.strip(chr(10))}\n\n"

    def on_li(self, node: Node) -> str:
        orphan = not self.lists
        if orphan:
            self.lists.append({"ordered": False, "n": 0})
        current = self.lists[-1]
        current["n"] += 1
        self.in_item += 1
        text = self.children(node).strip("\n")
        self.in_item -= 1
        marker = f"{current['n']}." if current["ordered"] else self.o.bullet
        lines = _BLOCKS.sub("\n\n", text).strip().split("\n")
        own = "\n".join([lines[0], *(x if not x.strip() or re.match(r"\s*([*+-]|\d+\.)   ", x) else "    " * len(self.lists) + x.strip() for x in lines[1:])])
        out = f"{'    ' * (len(self.lists) - 1)}{marker}   {own}\n"
        if orphan:
            self.lists.pop()
        return out

    def on_blockquote(self, node: Node) -> str:
        text = _BLOCKS.sub("\n\n", self.children(node)).strip()
        return "\n\n" + "\n".join(f"> {line}".rstrip() if line else ">" for line in text.split("\n")) + "\n\n" if text else ""

    # tables

    def on_table(self, node: Node) -> str:
        self.tables.append({"header": False})
        out = self.children(node).strip("\n")
        self.tables.pop()
        return f"\n\n{out}\n\n" if out.strip() else ""

    def on_tr(self, node: Node) -> str:
        cells = [c for c in node.children if c.tag in ("td", "th")]
        state = self.tables[-1] if self.tables else {"header": False}
        is_header = any(c.tag == "th" for c in cells)
        if not is_header and not state["header"]:
            return self.children(node).strip() + "\n"  # a table without header cells only lays out
        texts = [re.sub(r"\s+", " ", self.children(c)).strip().replace("|", "\\|") for c in cells]
        row = f"| {' | '.join(texts)} |\n"
        if is_header and not state["header"]:
            state["header"] = True
            edge = {"left": ":---", "right": "---:", "center": ":---:"}
            row += f"| {' | '.join(edge.get(c.attrs.get('align', '').lower(), '---') for c in cells)} |\n"
        return row

    def on_cell(self, node: Node) -> str:
        text = self.children(node).strip()
        return f"{text}\n" if text else ""

    # forms and formulas

    def on_input(self, node: Node) -> str:
        return "- [x] " if node.attrs.get("type", "").lower() == "checkbox" else ""

    def on_label(self, node: Node) -> str:
        text = self.children(node).strip()
        return f"{text} " if text else ""

    def on_select(self, node: Node) -> str:
        text = self.children(node).strip("\n")
        return f"\n\n{text}\n\n" if text else ""

    def on_option(self, node: Node) -> str:
        value = node.attrs.get("value", "")
        return f"{value}\n" if value else ""

    def on_math(self, node: Node) -> str:
        formula = node.attrs.get("alttext") or mathml(node)
        if not formula:
            return ""
        return f"\n\n$${formula}$$\n\n" if node.attrs.get("display") == "block" else f"${formula}$"


_ALIAS = {f"h{i}": "heading" for i in range(1, 7)} | {
    "b": "strong", "i": "em", "s": "del", "strike": "del", "ul": "list", "ol": "list", "td": "cell", "th": "cell", "video": "media", "audio": "media", "details": "div",
}


def mathml(node: Node) -> str:
    """LaTeX of the commonest elements of MathML."""
    if node.tag is None:
        return node.text.strip()
    parts = [mathml(c) for c in node.children if c.tag is not None or c.text.strip()]
    shapes = {"mfrac": r"\frac{{{0}}}{{{1}}}", "msup": "{0}^{{{1}}}", "msub": "{0}_{{{1}}}", "msqrt": r"\sqrt{{{0}}}", "mroot": r"\sqrt[{1}]{{{0}}}", "msubsup": "{0}_{{{1}}}^{{{2}}}"}
    if node.tag in shapes and len(parts) >= shapes[node.tag].count("{") // 3:
        try:
            return shapes[node.tag].format(*(parts if node.tag != "msqrt" else ["".join(parts)]))
        except IndexError:
            return "".join(parts)
    return "" if node.tag == "annotation" else "".join(parts)


def to_markdown(root: Node, options: RenderOptions | None = None, **changes: object) -> tuple[str, list[dict], list[dict]]:
    """(markdown, links, images) of a tree."""
    renderer = Renderer(replace(options or RenderOptions(), **changes) if changes else options)
    return renderer.render(root), renderer.links, renderer.images
