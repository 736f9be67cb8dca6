"""Markdown rules on small pages."""

from __future__ import annotations

import pytest

from pagewright.kernel import narrow as nw
from pagewright.kernel.css import SelectorError, select
from pagewright.kernel.render import RenderOptions, Renderer, to_markdown, video_page
from pagewright.kernel.tree import depth_and_count, parse_html
from pagewright.kernel.url import normalise, resolve


def md(html: str, **options: object) -> str:
    return to_markdown(parse_html(f"<html><body>{html}</body></html>"), RenderOptions(), **options)[0]


CASES = [
    ("<h1>Harbour fees</h1>", {}, "# Harbour fees"), ("<h6>Annex</h6>", {}, "###### Annex"), ("<h1></h1>", {}, ""), ("<h2>A</h2><p>b</p>", {}, "## A\n\nb"),
    ("<h1>Quay</h1>", {"heading_style": "setext"}, "Quay\n===="), ("<h2>Low tide</h2>", {"heading_style": "setext"}, "Low tide\n--------"), ("<h3>Rope</h3>", {"heading_style": "setext"}, "### Rope"),
    ("<b>heavy load</b>", {}, "**heavy load**"), ("<strong>x</strong>", {"strong": "__"}, "__x__"), ("<strong></strong>", {}, ""), ("<i>by night</i>", {}, "_by night_"), ("<em>a_b</em>", {}, "_a\\_b_"), ("<em>x</em>", {"em": "*"}, "*x*"),
    ('<a href="/p">t</a>', {"base": "https://h/x"}, "[t](https://h/p)"), ('<a href="/p">t</a>', {"base": "blob:abc"}, "[t](/p)"), ("<a>t</a>", {}, "[t]()"), ('<a href="https://quay.example">C</a>', {"link_style": "discarded"}, "C"),
    ('<a href="u">C</a>', {"link_style": "referenced"}, "[C][1]\n\n[1]: u"), ('<a href="u">C</a>', {"link_style": "referenced", "link_reference": "collapsed"}, "[C][]\n\n[C]: u"), ('<a href="u">C</a>', {"link_style": "referenced", "link_reference": "shortcut"}, "[C]\n\n[C]: u"),
    ('<h2><a href="https://quay.example">L</a></h2>', {}, "## [L](https://quay.example)"), ('<img src="s" alt="a" title="T">', {}, '![a](s "T")'), ('<img src="s">', {}, "![](s)"),
    ("<code>  x </code>", {}, "`x`"), ('<pre><code class="language-js">a\nb</code></pre>', {}, "```js\na\nb\n```"), ("first<pre><code>tie()\ncast()</code></pre>", {"code_style": "indented"}, "first\n\n    tie()\n    cast()"), ("<pre>knots  7</pre>", {}, "knots  7"),
    ("<ul><li>T<ul><li>S</li></ul></li></ul>", {}, "*   T\n    *   S"), ("<ol><li>a<ol><li>b</li></ol></li></ol>", {}, "1.   a\n    1.   b"), ("<ul><li>oar</li></ul>", {"bullet": "-"}, "-   oar"), ("<li>buoy</li>", {}, "*   buoy"),
    ("<blockquote><p>q</p></blockquote>", {}, "> q"), ("<hr>", {}, "* * *"), ("<hr>", {"hr": "---"}, "---"), ("<del>g</del>", {}, "~~g~~"), ("<s></s>", {}, ""), ("<b>a</b> <i>b</i>", {}, "**a**_b_"),
    ("<table><tr><th>A</th><th align=right>B</th></tr><tr><td>1</td><td>2</td></tr></table>", {}, "| A | B |\n| --- | ---: |\n| 1 | 2 |"), ("<p><b>T<br><p>A</p>", {}, "**T\n\nA**"),
    ("<script>x()</script><style>b{}</style><p>v</p>", {}, "v"), ('<input type="checkbox">', {}, "- [x]"), ("<p>a</p><math alttext='x^2'></math>", {}, "a\n\n$x^2$"), ("<mark>m</mark>", {"keep": frozenset(["mark"])}, "<mark>m</mark>"),
    ('<a href="/q">t</a>', {"links": "none"}, ""), ('<a href="/q">t</a><a>u</a>', {"links": "text"}, "t"), ('<img src="/i.png" alt="x"><img src="/j.png">', {"images": "all"}, "![Image 1: x](/i.png)![Image 2](/j.png)"),
    ('<img src="/i.png" alt="x">', {"images": "alt"}, "(Image 1: x)"), ('<img src="/i.png" alt="x">', {"images": "none"}, ""), ('<video src="/v.mp4"></video>', {"media": "link", "base": "https://h"}, "[Video 1](https://h/v.mp4)"),
    ('<iframe src="//www.youtube.com/embed/abc"></iframe>', {"media": "link"}, "[Video 1](https://www.youtube.com/watch?v=abc)"), ('<audio><source src="a.mp3"></audio>', {"media": "text"}, "(Audio 1)"),
]


@pytest.mark.parametrize(("html", "options", "expected"), CASES)
def test_rules(html: str, options: dict, expected: str) -> None:
    assert md(html, **options) == expected


def test_no_gfm() -> None:
    assert "| A |" not in md("<table><tr><th>A</th></tr></table>", gfm=False)
    assert "<table>" in md("<table><tr><th>A</th></tr></table>", gfm="table")


def test_custom_rules_wrap_in_order() -> None:
    a, b = (("mark",), lambda out, node, r: f"[A:{out}]"), (("mark",), lambda out, node, r: f"[B:{out}]")
    assert md("<mark>x</mark>", rules=(a, b)) == "[B:[A:x]]"


def test_ledgers() -> None:
    r = Renderer(RenderOptions())
    r.render(parse_html('<a href="a" title="A">x</a><a href="b">y</a><a href="a" title="A">z</a><img src="i" alt="t">'))
    assert [(x["href"], x["ref"]) for x in r.links] == [("a", 1), ("b", 2)]
    assert r.images == [{"src": "i", "alt": "t", "ref": 1}]


def test_selectors() -> None:
    root = parse_html('<div id=a class="x y"><p>1</p><p data-k="v1">2</p><ul><li>a<li>b</ul></div><p>3</p>')
    n = lambda s: len(select(root, s))
    assert [n("p"), n("#a > p"), n(".x.y p"), n("p + p"), n("p ~ ul"), n("[data-k^=v]"), n("p:not([data-k])"), n("li:first-child"), n("li:nth-child(2)"), n("p, li")] == [3, 2, 2, 1, 1, 1, 2, 1, 1, 5]
    with pytest.raises(SelectorError):
        select(root, "p >> !")


def test_narrow_and_inventories() -> None:
    html = '<html lang=de><head><title> T </title><meta name=description content=D></head><body><nav><a href="/n">n</a></nav><article><h1>H</h1><a href="x?q=1">l</a><img data-src="/i.png" src="data:x" width=5></article></body></html>'
    root = parse_html(html)
    assert nw.title_of(root) == "T"
    assert nw.description_of(root) == "D"
    assert nw.metadata(root) == {"lang": ["de"], "description": ["D"]}
    assert nw.link_inventory(root, "https://h/p/") == [("n", "https://h/n"), ("l", "https://h/p/x?q=1")]
    assert nw.image_inventory(root, "https://h/") == [{"src": "https://h/i.png", "alt": None, "width": 5, "height": None}]
    assert nw.inner_text(nw.narrow(parse_html(html), ["article"], ["a"])) == "H"
    assert nw.narrow(parse_html(html), ["section"]) is None
    kept = nw.narrow(parse_html(html), ["article"])  # the head stays
    assert (nw.title_of(kept), nw.description_of(kept), nw.metadata(kept)["lang"]) == ("T", "D", ["de"])
    assert depth_and_count(parse_html("<p><b>x</b></p>")) == (4, 4)


def test_urls() -> None:
    assert resolve("../a b?x=ü", "HTTP://Exa.com:80/p/q/r") == "http://exa.com/p/a%20b?x=%C3%BC"
    assert resolve("//h", "https://b") == "https://h/"
    assert resolve("mailto:a@b", "https://b") == "mailto:a@b"
    assert normalise("https://a.b/?utm_source=x&k=1")[0] == "https://a.b/?k=1"
    assert normalise("http://10.0.0.1/")[1] == "private address"
    assert video_page("https://player.vimeo.com/video/12") == "https://vimeo.com/12"
    for own in ("https://player.twitch.tv/?channel=x", "HTTPS://clips.twitch.tv/embed?clip=y", "https://v.qq.com/txp/iframe/player.html?vid=1", "https://player.bilibili.com/player.html?aid=7"):
        assert video_page(own) == own


def test_clean_for_lm() -> None:
    out = nw.clean_for_lm('<div class="flex p-4 card" data-x=1 style="color:red"><!-- c --><img src="data:abc"></div>')
    assert 'class="card"' in out
    assert 'class="content list table sidebar-box caption"' in nw.clean_for_lm('<p class="content list table sidebar-box caption text-lg">x</p>')
    assert "data-x" not in out and "<!--" not in out and "blob:opaque" in out
