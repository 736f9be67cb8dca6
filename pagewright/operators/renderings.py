"""Queries over markup, addresses, events and JSON built from result rows, so that SQL can tell what must come out.

Each case is a text, such as a page's markup, and what is expected of it, with the provider, host, number and rank of a row in their places.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import markup, urls
from pagewright.kernel.narrow import clean_for_lm
from pagewright.kernel.render import RenderOptions
from pagewright.operators import prompts, results
from pagewright.operators.pages import read_pages, trimmed_to_tokens
from pagewright.sources.documents import csv_markdown, parse_feed
from pagewright.storage import table

#: Columns of a row by their sign in a case.
SIGNS = {"{p}": "provider", "{h}": "coalesce(source, 'none')", "{n}": "cast(entry_id as string)", "{k}": "cast(rank as string)"}
BASE = "https://{h}/d/"
_LINKS = "<p>See <a href='/p/{n}?q={k}' title='t {k}'>{p} {n}</a> and <a href='https://{h}/'>{h}</a>.</p>"
_IMAGES = "<p><img src='/i{n}.png' alt='{p} {n}'></p><p><img src='https://{h}/x{k}.png'></p>"

#: name: (markup, options of the rendering, markdown)
MARKDOWN: dict[str, tuple[str, dict, str]] = {
    "md_blocks": ("<h1>{p} {n}</h1><h3>{h}</h3><p>one {n}</p><p>two<br>three</p><hr><p>{p}</p>", {}, "# {p} {n}\n\n### {h}\n\none {n}\n\ntwo\n\nthree\n\n* * *\n\n{p}"),
    "md_setext": ("<h1>{p}</h1><h2>two</h2><h3>{h}</h3><p>{n}</p>", {"heading_style": "setext"}, "{p}\n=====\n\ntwo\n---\n\n### {h}\n\n{n}"),
    "md_lists": ("<p>{n}</p><ul><li>{p}</li><li>{h}<ul><li>deep {k}</li></ul></li></ul><ol><li>x{n}</li><li>y</li></ol>", {}, "{n}\n\n*   {p}\n*   {h}\n    *   deep {k}\n\n1.   x{n}\n2.   y"),
    "md_links": (_LINKS, {}, 'See [{p} {n}](https://{h}/p/{n}?q={k} "t {k}") and [{h}](https://{h}/).'),
    "md_links_referenced": (_LINKS, {"link_style": "referenced"}, 'See [{p} {n}][1] and [{h}][2].\n\n[1]: https://{h}/p/{n}?q={k} "t {k}"\n[2]: https://{h}/'),
    "md_links_text": (_LINKS, {"links": "text"}, "See {p} {n} and {h}."),
    "md_links_none": (_LINKS, {"links": "none"}, "See  and ."),
    "md_links_discarded": (_LINKS, {"link_style": "discarded"}, "See {p} {n} and {h}."),
    "md_links_cited": (_LINKS, {"links": "gpt-oss"}, "See 【1†{p} {n}】 and 【2†{h}】."),
    "md_images": (_IMAGES, {}, "![{p} {n}](https://{h}/i{n}.png)\n\n![](https://{h}/x{k}.png)"),
    "md_images_alt": (_IMAGES, {"images": "alt"}, "(Image 1: {p} {n})"),
    "md_images_numbered": (_IMAGES, {"images": "all_p"}, "![Image 1: {p} {n}](https://{h}/i{n}.png)\n\n![Image 2](https://{h}/x{k}.png)"),
    "md_images_none": (_IMAGES + "<p>{k}</p>", {"images": "none"}, "{k}"),
    "md_code": ("<pre><code class='language-js'>let {p} = {n};\nrun();</code></pre><p>use <code>{p}{k}</code> twice</p>", {}, "```js\nlet {p} = {n};\nrun();\n```\n\nuse `{p}{k}` twice"),
    "md_quote": ("<blockquote><p>{p} {n}</p><p>{h}</p></blockquote>", {}, "> {p} {n}\n>\n> {h}"),
    "md_table": ("<table><thead><tr><th>{p}</th><th>b</th></tr></thead><tbody><tr><td>{n}</td><td>c|{k}</td></tr><tr><td>{h}</td><td>d</td></tr></tbody></table>", {}, "| {p} | b |\n| --- | --- |\n| {n} | c\\|{k} |\n| {h} | d |"),
    "md_emphasis": ("<p>a <strong>{p} {n}</strong> b <em>{h}</em> c <del>old {k}</del> d</p>", {}, "a **{p} {n}** b _{h}_ c ~~old {k}~~ d"),
    "md_figure": ("<figure><img src='/x.png' alt={p}><figcaption>caption {n}</figcaption></figure>", {}, "![{p}](https://{h}/x.png)\n\ncaption {n}"),
    "md_skipped": ("<script>var {p}</script><style>.{p} i</style><p>{n}</p><!-- {h} --><div>{h}</div>", {}, "{n}\n\n{h}"),
}

_PAGE = "<html lang=de><head><title> {p}  {n} </title><meta name=description content='About {h}'><meta property='og:site' content={h}></head><body><nav><a href='/n{k}'>menu</a></nav><main><h1>{p} {n}</h1><p class=lead>text {k}</p><a href='x?q={n}'>{h}</a><img src='/i{n}.png' alt={p} width={k}></main><footer>end {n}</footer></body></html>"
#: name: (output, target selectors, remove selectors, expression on the output, value)
NARROWED: dict[str, tuple[str, list[str] | None, list[str] | None, Callable[[Column], Column], str]] = {
    "dom_title": ("title", None, None, lambda c: c, "{p} {n}"),
    "dom_description": ("description", None, None, lambda c: c, "About {h}"),
    "dom_metadata": ("metadata", None, None, lambda c: F.concat_ws("|", F.element_at(c["lang"], 1), F.element_at(c["og:site"], 1)), "de|{h}"),
    "dom_target": ("text", ["main > p.lead"], None, lambda c: c, "text {k}"),
    "dom_target_title": ("title", ["main"], None, lambda c: c, "{p} {n}"),
    "dom_links": ("links", None, None, lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["text"], F.lit(">"), x["href"])), "|"), "menu>https://{h}/n{k}|{h}>https://{h}/d/x?q={n}"),
    "dom_remove": ("links", None, ["nav", "footer"], lambda c: F.array_join(F.transform(c, lambda x: x["href"]), "|"), "https://{h}/d/x?q={n}"),
    "dom_images": ("images", None, None, lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["alt"], F.lit(">"), x["src"], F.lit(">"), x["width"].cast("string"))), "|"), "{p}>https://{h}/i{n}.png>{k}"),
}


@F.pandas_udf(T.StringType())
def _csv(text: pd.Series) -> pd.Series:
    return pd.Series([csv_markdown(t) for t in text], dtype=object)


@F.pandas_udf(T.StringType())
def _feed(text: pd.Series) -> pd.Series:
    found = [parse_feed(t) for t in text]
    return pd.Series([f"{kind}:" + "|".join(f"{e['title']}>{e['link']}" for e in entries) for kind, entries in found], dtype=object)


@F.pandas_udf(T.StringType())
def _clean(html: pd.Series) -> pd.Series:
    return pd.Series([clean_for_lm(h) for h in html], dtype=object)


def _pieces(text: Column) -> Column:
    """Kind and text of parts such as `kind=text`, divided by bars."""
    return F.transform(F.split(text, r"\|"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("kind"), F.substring_index(x, "=", -1).alias("text")))


def _join(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda x: F.concat(x["kind"], F.lit("="), x["text"])), "|")


def _events(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda x: F.concat_ws(">", F.coalesce(x["event"], F.lit("-")), x["data"], x["id"], x["retry"].cast("string"))), "|")


def _cookie(text: Column) -> Column:
    """Whether a cookie of `domain path` goes with a request of `host path`."""
    part = lambda k: F.get(F.split(text, " "), F.lit(k))
    null = F.lit(None).cast("timestamp")
    return results.cookie_applies(part(0), part(1), F.lit(True), null, part(2), part(3), F.lit("https"), F.current_timestamp()).cast("string")


#: name: (text, expression on it, value)
VALUES: dict[str, tuple[str, Callable[[Column], Column], str]] = {
    "url_video": ("//www.youtube.com/embed/{p}{n}?x=1", urls.video_canonical, "https://www.youtube.com/watch?v={p}{n}"),
    "url_video_kept": ("https://clips.twitch.tv/embed?clip={p}{n}", urls.video_canonical, "https://clips.twitch.tv/embed?clip={p}{n}"),
    "url_redirect": ("https://search.example/l/?uddg=https%3A%2F%2F{h}%2F{n}%3Fa%3D{k}&rut=1", urls.search_target, "https://{h}/{n}?a={k}"),
    "url_redirect_query": ("/url?sa=t&q=https%3A%2F%2F{h}%2F{n}&ved=1", urls.search_target, "https://{h}/{n}"),
    "url_scheme": ("{h}/{p}?n={n}", urls.with_scheme, "https://{h}/{p}?n={n}"),
    "url_fix": ("https://reader.example/https://https://{h}/{n}", lambda c: urls.attempt_url_fix(c, "reader.example"), "https://{h}/{n}"),
    "url_resolve": ("../{p}/./a b?n={n}", lambda c: urls.resolve_url(c, F.lit("https://x.example/d/e/f")), "https://x.example/d/{p}/a%20b?n={n}"),
    "url_decode": ("a%20{n}+%C3%A9{p}", urls.decode_component, "a {n}+é{p}"),
    "sse_encode": ("{p}\n{n}", lambda c: markup.sse_event(F.lit("row"), c, F.lit("7")), "event: row\nid: 7\ndata: {p}\ndata: {n}\n\n"),
    "sse_decode": ("event: {p}\ndata: {n}\ndata: x\n\n: note\n\ndata: {h}\nid: {k}\nretry: 5\n\n", lambda c: _events(markup.sse_events(c)), "{p}>{n}\nx|->{h}>{k}>5"),
    "json_envelope": ("{h} {n}", results.json_envelope, '{"code":200,"status":20000,"data":"{h} {n}"}'),
    "json_completed": ('note: [1, {k}, "{h}", {"a": "{p}', lambda c: prompts.tolerant_json(c, contaminated=True, abrupt=True)["value"], '[1, {k}, "{h}", {"a": "{p}"}]'),
    "json_focus": ('{"a": {"b": [0, {"c": "{p}{n}"}]}}', lambda c: prompts.tolerant_json(c, "a.b.1.c")["value"], '"{p}{n}"'),
    "chunks_merged": ("text=a{n}|text=b|image=x|text={p}", lambda c: _join(prompts.merge_text_chunks(_pieces(c))), "text=a{n}b|image=x|text={p}"),
    "chunks_text": ("text=a{n}|image=x|text={p}", lambda c: prompts.chunks_text(_pieces(c)), "a{n}[Image]{p}"),
    "csv_grid": ("name,n\n{p},{n}\n\"{h}, x\",{k}\n", _csv, "| name | n |\n| --- | --- |\n| {p} | {n} |\n| {h}, x | {k} |"),
    "feed_items": ("<rss><channel><title>c</title><item><title>{p} {n}</title><link>https://{h}/{n}</link></item><item><title>two</title><link>u{k}</link></item></channel></rss>", _feed, "rss:{p} {n}>https://{h}/{n}|two>u{k}"),
    "feed_sitemap": ("<urlset><url><loc>https://{h}/{n}</loc></url><url><loc>{p}</loc></url></urlset>", _feed, "urlset:>https://{h}/{n}|>{p}"),
    "clean_markup": ('<div class="flex p-4 card content" data-x="{k}" style="color:red"><!-- {p} --><a href="/{n}" aria-label="{p}">{h}</a></div>', _clean, '<html><body><div class="card content"><a href="/{n}">{h}</a></div></body></html>'),
    "cookie_sent": (".{h} /{p} www.{h} /{p}/{n}", _cookie, "true"),
    "cookie_withheld": ("{h} /{p} {h} /{p}x/{n}", _cookie, "false"),
    "tidy_links": ("a\n[\n\n{p} {n}\n\n](https://{h})\n\n\n\n  b", markup.tidy_markdown, "a\n[{p} {n}](https://{h})\n\nb"),
    "squeezed_lines": ("{p}\n\n\n\n{n}\n\n{h}", markup.squeeze_lines, "{p}\n\n{n}\n\n{h}"),
    "trimmed_tokens": ("{p} {p} {p}, tail {h} more", lambda c: trimmed_to_tokens(c, 4), "{p} {p} {p},"),
}


def _rows(spark: SparkSession, sf_dir: str, markup: str) -> DataFrame:
    rows = table(spark, sf_dir, "serp_entries").dropDuplicates(["entry_id"])
    return rows.select(F.col("entry_id").alias("page_id"), _filled(BASE).alias("url"), _filled(markup).alias("html"))


def _filled(text: str) -> Column:
    out = F.lit(text)
    for sign, expression in SIGNS.items():
        out = F.replace(out, F.lit(sign), F.expr(expression))
    return out


def _sql(expected: str) -> str:
    out = "'" + expected.replace("'", "''") + "'"
    for sign, expression in SIGNS.items():
        out = f"replace({out}, '{sign}', {expression.replace('string', 'varchar')})"
    return f"select distinct entry_id, {out} as result from serp_entries"


def _valued(text: str, value: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "serp_entries").dropDuplicates(["entry_id"]).select("entry_id", _filled(text).alias("text"))
        return rows.select("entry_id", value(F.col("text")).alias("result"))

    return run


def _rendered(markup: str, options: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read_pages(_rows(spark, sf_dir, markup), ("markdown",), RenderOptions(**options)).select(F.col("page_id").alias("entry_id"), F.col("markdown").alias("result"))

    return run


def _narrowed(output: str, target: list[str] | None, remove: list[str] | None, value: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        read = read_pages(_rows(spark, sf_dir, _PAGE), (output,), target=target, remove=remove)
        return read.select(F.col("page_id").alias("entry_id"), value(F.col(output)).alias("result"))

    return run


QUERIES = {name: _rendered(markup, options) for name, (markup, options, _) in MARKDOWN.items()} | {name: _narrowed(*case[:4]) for name, case in NARROWED.items()} | {name: _valued(*case[:2]) for name, case in VALUES.items()}
ORACLE = {name: _sql(case[2]) for name, case in (MARKDOWN | VALUES).items()} | {name: _sql(case[4]) for name, case in NARROWED.items()}
