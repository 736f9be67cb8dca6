"""Operators on tables of pages: markdown, inventories, metadata, text, narrowing; the kernels fused into one pass over the page."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.kernel import narrow as nw
from pagewright.kernel.render import RenderOptions, to_markdown
from pagewright.kernel.tree import depth_and_count, parse_html
from pagewright.storage import provide_package, table

#: Beyond these a page is rendered as plain text: depth, elements. Pages beyond MAX_BYTES aren't parsed.
MAX_DEPTH, MAX_ELEMENTS, MAX_BYTES = 256, 80_000, 32 << 20
#: A reader view shorter than this share of the whole page's text isn't used.
READABLE_SHARE = 0.3

_OUT = {
    "title": ("string", pa.string()), "description": ("string", pa.string()), "markdown": ("string", pa.string()), "text": ("string", pa.string()), "max_depth": ("int", pa.int32()), "n_elements": ("int", pa.int32()),
    "metadata": ("map<string,array<string>>", pa.map_(pa.string(), pa.list_(pa.string()))),
    "links": ("array<struct<text:string,href:string>>", pa.list_(pa.struct([("text", pa.string()), ("href", pa.string())]))),
    "images": ("array<struct<src:string,alt:string,width:int,height:int>>", pa.list_(pa.struct([("src", pa.string()), ("alt", pa.string()), ("width", pa.int32()), ("height", pa.int32())]))),
    "error": ("string", pa.string()),
}
OUTPUTS = tuple(_OUT)


def poorly_transformed(markdown: str | None) -> bool:
    """Whether a rendering is no use: empty, one line, or still a tag."""
    text = (markdown or "").strip()
    return not text or "\n" not in text or (text.startswith("<") and text.endswith(">"))


def render_page(html: str, url: str | None, wanted: set[str], options: RenderOptions, target: list[str] | None, remove: list[str] | None, content_only: bool) -> dict:
    """The wanted outputs of one page. Never raises: what goes wrong is in `error`."""
    try:
        root = nw.narrow(parse_html(html), target, remove)
        if root is None:
            return {"error": "no element matches the target selector"}
        out: dict = {}
        depth, count = depth_and_count(root) if wanted & {"max_depth", "n_elements", "markdown"} else (0, 0)
        out["max_depth"], out["n_elements"] = depth, count
        if "title" in wanted:
            out["title"] = nw.title_of(root)
        if "description" in wanted:
            out["description"] = nw.description_of(root)
        if "metadata" in wanted:
            out["metadata"] = list(nw.metadata(root).items())
        if "text" in wanted:
            out["text"] = nw.inner_text(root)
        if "links" in wanted:
            out["links"] = [{"text": t, "href": h} for t, h in nw.link_inventory(root, url or "")]
        if "images" in wanted:
            out["images"] = nw.image_inventory(root, url or "")
        if "markdown" in wanted:
            own = replace(options, base=options.base or url or "")
            if depth > MAX_DEPTH or count > MAX_ELEMENTS:
                out["markdown"] = nw.inner_text(root)
            else:
                out["markdown"] = to_markdown(root, own)[0]
                if content_only and not target:
                    view = nw.readable(html)
                    if view:
                        part = parse_html(f"<html><body>{view['content']}</body></html>")
                        short, whole = (to_markdown(r, own, link_style="discarded")[0] for r in (part, root))
                        if len(short) >= READABLE_SHARE * len(whole):
                            chosen = to_markdown(part, own)[0]
                            out["markdown"] = out["markdown"] if poorly_transformed(chosen) else chosen
                    if poorly_transformed(out["markdown"]):
                        out["markdown"] = nw.inner_text(root)
        return out
    except (RecursionError, ValueError, KeyError, IndexError) as e:
        return {"error": f"{type(e).__name__}: {e}"[:300]}


def read_pages(
    pages: DataFrame, outputs: tuple[str, ...] = ("markdown",), options: RenderOptions | None = None, target: list[str] | None = None, remove: list[str] | None = None, html: str = "html", url: str = "url", content_only: bool = False
) -> DataFrame:
    """`pages` with the asked outputs added in one pass: each page is parsed once, and only what is asked is computed.

    A null page has null outputs; a page beyond MAX_BYTES, or one that goes wrong, has `error` set and the others null. Columns
    with an output's name are replaced.
    """
    provide_package(pages.sparkSession)
    names = [n for n in OUTPUTS if n in outputs or n == "error"]
    keep = [c for c in pages.columns if c not in names]
    wanted, own = set(names), options or RenderOptions(drop_irrelevant=True, images="all", media="link", links="all")
    body = pages.select(*keep, F.when(F.octet_length(html) <= MAX_BYTES, F.col(html)).alias("_html"), F.col(url).alias("_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                render_page(h, u, wanted, own, target, remove, content_only) if h is not None else {}
                for h, u in zip(batch.column("_html").to_pylist(), batch.column("_url").to_pylist(), strict=True)
            ]
            made = [pa.array([r.get(n) for r in rows], _OUT[n][1]) for n in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, *names])

    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{n}` {_OUT[n][0]}" for n in names)])
    return body.mapInArrow(run, schema)


def register(spark: SparkSession) -> None:
    """Makes the kernels SQL functions: to_markdown(html, url), page_text(html), page_links(html, url), clean_html(html)."""
    provide_package(spark)

    @F.pandas_udf("string")
    def markdown(html: pd.Series, url: pd.Series) -> pd.Series:
        own = RenderOptions(drop_irrelevant=True)
        return pd.Series([None if h is None else render_page(h, u, {"markdown"}, own, None, None, False).get("markdown") for h, u in zip(html, url, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else nw.inner_text(parse_html(h)) for h in html], dtype=object)

    @F.pandas_udf("array<struct<text:string,href:string>>")
    def links(html: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else [{"text": t, "href": x} for t, x in nw.link_inventory(parse_html(h), u or "")] for h, u in zip(html, url, strict=True)])

    @F.pandas_udf("string")
    def clean(html: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else nw.clean_for_lm(h) for h in html], dtype=object)

    for name, f in (("to_markdown", markdown), ("page_text", text), ("page_links", links), ("clean_html", clean)):
        spark.udf.register(name, f)


_TOKEN = r"(?:[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[\p{L}\p{M}]+|\p{Nd}{1,3}|[^\s\p{L}\p{M}\p{Nd}])"


def trimmed_to_tokens(text: Column, most: int) -> Column:
    """The text up to its first `most` tokens by the rule of `estimated_tokens`."""
    tokens = F.regexp_extract_all(text, F.lit(r"\s*" + _TOKEN), F.lit(0))
    return F.when(F.size(tokens) > most, F.array_join(F.slice(tokens, 1, most), "")).otherwise(text)


#: The rule of `estimated_tokens` in SQL of the checks.
TOKEN_SQL = r"len(regexp_extract_all(%s, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{M}]+|\p{Nd}{1,3}|[^\s\p{L}\p{M}\p{Nd}]'))"


def estimated_tokens(text: Column) -> Column:
    """Tokens by a fixed rule: words of letters, single wide letters, runs of up to three digits and other marks."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[\p{L}\p{M}]+|\p{Nd}{1,3}|[^\s\p{L}\p{M}\p{Nd}]"), F.lit(0)))


def _snapshots(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Distinct snapshots' columns; redelivered rows are alike in them."""
    return table(spark, sf_dir, "snapshots").select(*columns)


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: markdown and its estimated tokens for every page."""
    pages = read_pages(_snapshots(spark, sf_dir, "page_id", "url", "html"), ("title", "markdown"))
    return pages.select("page_id", "url", "title", "markdown", estimated_tokens(F.col("markdown")).alias("tokens"), "error").distinct()


def page_main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_pages(_snapshots(spark, sf_dir, "page_id", "url", "html"), ("markdown",), content_only=True)
    return pages.select("page_id", F.md5("markdown").alias("content_md5"), F.length("markdown").alias("content_length")).distinct()


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(_snapshots(spark, sf_dir, "page_id", "url", "html"), ("title",)).select("page_id", F.col("title").alias("page_title")).distinct()


def page_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_pages(_snapshots(spark, sf_dir, "page_id", "url", "html"), ("metadata",))
    return read.select("page_id", F.element_at(F.col("metadata")["lang"], 1).alias("page_lang")).distinct()


def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_pages(_snapshots(spark, sf_dir, "page_id", "url", "html"), ("links",))
    return read.select("page_id", F.size("links").cast("long").alias("n_links")).distinct()


def link_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_pages(_snapshots(spark, sf_dir, "page_id", "url", "html"), ("links",)).select("page_id", "links").distinct()
    return read.select("page_id", F.posexplode("links").alias("ord", "link")).select("page_id", "ord", "link.text", "link.href")


def image_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_pages(_snapshots(spark, sf_dir, "page_id", "url", "html"), ("images",)).select("page_id", "images").distinct()
    return read.select("page_id", F.posexplode("images").alias("ord", "image")).select("page_id", "ord", "image.src", "image.alt")


def headings_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target selector: the first-level headings as text."""
    read = read_pages(_snapshots(spark, sf_dir, "page_id", "url", "html"), ("text",), target=["h1"])
    return read.filter("text is not null").select("page_id", F.col("text").alias("h1_text")).distinct()


def nav_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove selector: links that stay when menus, asides and footers are gone."""
    read = read_pages(_snapshots(spark, sf_dir, "page_id", "url", "html"), ("links",), remove=["nav", "aside", "footer"])
    return read.select("page_id", F.size("links").cast("long").alias("n_links_left")).distinct()


QUERIES = {
    "page_markdown": page_markdown, "page_main_content": page_main_content, "page_title": page_titles, "page_lang": page_langs, "link_count": link_counts, "link_inventory": link_inventory, "image_inventory": image_inventory,
    "target_h1": headings_only, "nav_removed": nav_removed,
}
ORACLE = {
    "page_title": r"""select distinct page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')), '') as page_title from snapshots""",
    "page_lang": r"""select distinct page_id, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') as page_lang from snapshots""",
    "link_count": r"""select distinct page_id, cast(len(regexp_extract_all(html, '<a\s[^>]*href="')) as bigint) as n_links from snapshots""",
}
