"""A tree of a tag-soup page: stack parser on the standard library's tokenizer."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(["script", "style", "textarea", "title"])
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that the start of another closes while they are on top of the stack.
_P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
IMPLIED = {name: {"p"} for name in _P_ENDS} | {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tr": {"tr", "th", "td", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    "tbody": {"tr", "td", "th", "thead", "tbody", "p"}, "thead": {"tr", "td", "th", "p"}, "tfoot": {"tr", "td", "th", "tbody", "thead", "p"}, "body": {"head", "title", "style", "script", "link"},
}


class Node:
    """An element, or a text (tag is None), or a comment (tag is `#comment`)."""

    __slots__ = ("attrs", "children", "parent", "tag", "text")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, text: str = "") -> None:
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def append(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None

    def walk(self):  # noqa: ANN201
        """This node and all below it, in document order, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def elements(self):  # noqa: ANN201
        return (n for n in self.walk() if n.tag and n.tag[0] != "#")

    def find(self, tag: str) -> Node | None:
        return next((n for n in self.elements() if n.tag == tag), None)

    def raw_text(self) -> str:
        return "".join(n.text for n in self.walk() if n.tag is None)

    def outer_html(self) -> str:
        if self.tag is None:
            return self.text if self.parent is not None and self.parent.tag in ("script", "style") else escape(self.text, quote=False)
        if self.tag == "#comment":
            return f"<!--{self.text}-->"
        inner = "".join(c.outer_html() for c in self.children)
        if self.tag == "#root":
            return inner
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" if self.tag in VOID else f"<{self.tag}{attrs}>{inner}</{self.tag}>"


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.stack = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ends = IMPLIED.get(tag)
        if ends:
            while self.stack[-1].tag in ends:
                self.stack.pop()
        if tag in ("html", "body", "head") and (same := next((n for n in self.stack if n.tag == tag), None)) is not None:
            for k, v in attrs:  # a second one only adds attributes
                same.attrs.setdefault(k, v or "")
            return
        node = self.stack[-1].append(Node(tag, {k: v or "" for k, v in reversed(attrs)}))
        node.attrs = {k: v or "" for k, v in attrs} if len({k for k, _ in attrs}) == len(attrs) else dict(reversed(list(node.attrs.items())))
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].tag == tag:
            self.stack.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.stack[-1].append(Node("br"))
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return
        if tag == "p":
            self.stack[-1].append(Node("p"))

    def handle_data(self, data: str) -> None:
        self.stack[-1].append(Node(None, text=data))

    def handle_comment(self, data: str) -> None:
        self.stack[-1].append(Node("#comment", text=data))


def parse_html(html: str) -> Node:
    """The root of the page's tree. Missing end tags close at the end; a fragment gets html and body elements."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    root = builder.root
    if root.find("html") is None:
        page, body = Node("html"), Node("body")
        for child in root.children:
            body.append(child)
        page.append(body)
        root.children = []
        root.append(page)
    return root


def depth_and_count(root: Node) -> tuple[int, int]:
    """Greatest depth (the root element is 1) and number of elements, without what is in svg."""
    deepest = count = 0
    stack = [(c, 1) for c in root.children]
    while stack:
        node, depth = stack.pop()
        if node.tag is None or node.tag[0] == "#":
            continue
        deepest, count = max(deepest, depth), count + 1
        if node.tag != "svg":
            stack += [(c, depth + 1) for c in node.children]
    return deepest, count
