"""Options of a read: fields, presets, headers, checks, and the plan they stand for."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import markup
from pagewright.kernel.render import RenderOptions
from pagewright.operators.chunks import chunk, parse_strategy
from pagewright.operators.pages import estimated_tokens, read_pages, trimmed_to_tokens

FORMATS = ("content", "markdown", "html", "text", "pageshot", "screenshot", "vlm", "readerlm", "frontmatter")
# Bundles of options by name.
PRESETS = {
    "reader": {"base": "final", "retain_images": "all", "retain_media": "html", "retain_links": "all", "respond_with": "frontmatter", "detach_invisibles": True, "remove_overlay": True, "markdown": {"link_style": "referenced", "link_reference": "full"}},
    "index": {"base": "final", "retain_images": "alt", "retain_media": "none", "retain_links": "text", "respond_with": "frontmatter", "markdown_chunking": "s3"},
    "research": {"base": "final", "retain_images": "all", "retain_media": "link", "retain_links": "all", "respond_with": "markdown+frontmatter", "markdown_chunking": "h3"},
    "agent": {"base": "final", "retain_images": "alt", "retain_media": "link", "retain_links": "all", "respond_with": "frontmatter", "markdown_chunking": "h3"},
    "spider": {"base": "final", "retain_images": "all", "retain_media": "link", "retain_links": "all", "respond_with": "markdown+frontmatter", "markdown_chunking": "h3", "with_links_summary": "all"},
}
_DOMAIN = {
    "base": ("initial", "final"), "retain_images": ("none", "all", "alt", "all_p", "alt_p"), "retain_media": ("none", "text", "link", "image", "html"), "retain_links": ("none", "all", "text", "gpt-oss"),
    "respond_timing": ("html", "visible-content", "mutation-idle", "resource-idle", "media-idle", "network-idle", None), "engine": ("auto", "browser", "curl", "cf-browser-rendering", None),
}


class OptionError(ValueError):
    """An option out of its domain, or two that exclude each other."""


@dataclass(frozen=True)
class ReadOptions:
    """What is asked of a read; names follow Python's habits, `from_headers` takes those of requests."""

    respond_with: str = "content"
    base: str = "initial"
    retain_images: str = "all"
    retain_media: str = "link"
    retain_links: str = "all"
    with_links_summary: bool | str = False
    with_images_summary: bool = False
    with_generated_alt: bool = False
    no_gfm: bool | str = False
    no_cache: bool = False
    cache_tolerance: float | None = None
    target_selector: tuple[str, ...] = ()
    remove_selector: tuple[str, ...] = ()
    wait_for_selector: tuple[str, ...] = ()
    keep_img_data_url: bool = False
    with_iframe: bool | str = False
    with_shadow_dom: bool = False
    remove_overlay: bool = False
    detach_invisibles: bool = False
    engine: str | None = None
    timeout: float | None = None
    page: int | None = None
    token_budget: int | None = None
    max_tokens: int | None = None
    assert_status: int | None = None
    respond_timing: str | None = None
    markdown_chunking: str | None = None
    robots_txt: str | None = None
    set_cookies: tuple[str, ...] = ()
    scripts: tuple[str, ...] = ()
    viewport: str | None = None
    instruction: str | None = None
    markdown: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, domain in _DOMAIN.items():
            if getattr(self, name) not in domain:
                raise OptionError(f"{name} can't be {getattr(self, name)!r}")
        parts = set(self.respond_with.split("+"))
        if not parts <= set(FORMATS):
            raise OptionError(f"respond_with can't be {self.respond_with!r}")
        if parts & {"vlm", "readerlm"} and parts & {"content", "markdown"}:
            raise OptionError("formats of language models exclude content and markdown")
        if self.timeout is not None and not 0 < self.timeout <= 180:
            raise OptionError("timeout must be in (0, 180]")
        if self.page is not None and self.page < 1:
            raise OptionError("page must be 1 or more")
        if self.max_tokens is not None and self.max_tokens < 500:
            raise OptionError("max_tokens must be 500 or more")
        for s in self.target_selector:
            if s.strip() == "*" or s.strip().startswith((":", "*:")):
                raise OptionError(f"selector {s!r} is too wide")

    @classmethod
    def preset(cls, name: str, **explicit: object) -> ReadOptions:
        if name not in PRESETS:
            raise OptionError(f"there is no preset {name!r}")
        return cls(**(PRESETS[name] | explicit))

    def not_default(self) -> dict[str, object]:
        """Options that differ from the defaults."""
        return {f.name: getattr(self, f.name) for f in fields(self) if asdict(self)[f.name] != asdict(ReadOptions())[f.name]}

    @property
    def cache_applies(self) -> bool:
        return not (self.no_cache or self.cache_tolerance == 0 or self.set_cookies or self.scripts or self.viewport or self.instruction or self.remove_overlay or self.detach_invisibles)

    @property
    def browser_needed(self) -> bool:
        shots = {"screenshot", "pageshot", "vlm"} & set(self.respond_with.split("+"))
        return bool(self.engine == "browser" or shots or self.wait_for_selector or self.scripts or self.with_iframe or self.with_shadow_dom or self.viewport or self.remove_overlay or self.detach_invisibles)

    @property
    def readability_needed(self) -> bool:
        return self.respond_timing == "visible-content" or "content" in self.respond_with.split("+")

    def renderer(self) -> RenderOptions:
        gfm = "table" if self.no_gfm == "table" else not self.no_gfm
        return RenderOptions(links=self.retain_links, images=self.retain_images, media=self.retain_media, keep_data_urls=self.keep_img_data_url, gfm=gfm, drop_irrelevant=True, omit_head="frontmatter" in self.respond_with, **self.markdown)


def from_headers(headers: dict[str, str], body: dict[str, object] | None = None) -> ReadOptions:
    """Options of a request: a preset, then the body's fields, then headers. Some headers only stand in for missing fields."""
    h = {k.lower(): v for k, v in headers.items()}
    body = dict(body or {})
    preset = h.get("x-preset") or body.pop("preset", None)
    if preset and preset not in PRESETS:
        raise OptionError(f"there is no preset {preset!r}")
    out: dict[str, object] = dict(PRESETS.get(preset, {})) | body
    wins = {"x-respond-with": "respond_with", "x-retain-images": "retain_images", "x-retain-media": "retain_media", "x-retain-links": "retain_links", "x-base": "base", "x-engine": "engine"}
    for name, key in wins.items():
        if name in h and (key not in _DOMAIN or h[name] in _DOMAIN[key]):  # unknown words are ignored
            out[key] = h[name]
    flags = {"x-no-cache": "no_cache", "x-keep-img-data-url": "keep_img_data_url", "x-with-images-summary": "with_images_summary", "x-with-generated-alt": "with_generated_alt", "x-with-shadow-dom": "with_shadow_dom", "x-remove-overlay": "remove_overlay", "x-detach-invisibles": "detach_invisibles"}
    for name, key in flags.items():
        if name in h:
            out[key] = loose(h[name])
    for name, key, words in (("x-with-links-summary", "with_links_summary", ("all", "gpt-oss")), ("x-with-iframe", "with_iframe", ("quoted",)), ("x-no-gfm", "no_gfm", ("table",))):
        if name in h:
            out[key] = h[name] if h[name] in words else loose(h[name])
    for name, key in (("x-target-selector", "target_selector"), ("x-remove-selector", "remove_selector"), ("x-wait-for-selector", "wait_for_selector")):
        if name in h and not out.get(key):
            out[key] = tuple(s.strip() for s in h[name].split(", ") if s.strip())
    whole = lambda v: int(m[0]) if (m := re.match(r"\s*[+-]?\d+", v)) else None
    if "x-timeout" in h and (n := whole(h["x-timeout"])) is not None:
        out["timeout"] = min(max(n, 1), 180)
    if "x-cache-tolerance" in h and (n := whole(h["x-cache-tolerance"])) is not None:
        out["cache_tolerance"] = n
    for name, key in (("x-token-budget", "token_budget"), ("x-max-tokens", "max_tokens"), ("x-assert-status-code", "assert_status"), ("x-page", "page")):
        if name in h and out.get(key) is None and (n := whole(h[name])) is not None:
            out[key] = max(1, n) if key == "page" else n
    for name, key in (("x-markdown-chunking", "markdown_chunking"), ("x-respond-timing", "respond_timing"), ("x-robots-txt", "robots_txt")):
        if name in h and out.get(key) is None and (key not in _DOMAIN or h[name] in _DOMAIN[key]):
            out[key] = h[name]
    styles = {k.removeprefix("x-md-").replace("-", "_"): v for k, v in h.items() if k.startswith("x-md-")}
    names = {"heading_style": "heading_style", "hr": "hr", "bullet_list_marker": "bullet", "em_delimiter": "em", "strong_delimiter": "strong", "link_style": "link_style", "link_reference_style": "link_reference"}
    if styles:
        out["markdown"] = {names[k]: v for k, v in styles.items() if k in names} | dict(out.get("markdown") or {})
    if out.get("no_cache"):
        out["cache_tolerance"] = 0
    if out.get("target_selector") and not out.get("wait_for_selector"):
        out["wait_for_selector"] = out["target_selector"]
    for key in ("target_selector", "remove_selector", "wait_for_selector"):
        if isinstance(out.get(key), str):
            out[key] = (out[key],)
        elif key in out:
            out[key] = tuple(out[key])
    return ReadOptions(**out)


def loose(word: str) -> bool:
    return word.strip().lower() not in markup.FALSE_WORDS


def links_summary(links, mode: bool | str = True):  # noqa: ANN001, ANN201
    """Links of a page for its summary: all in order, or, by default, the first of each address, the last of each text."""
    if mode == "all":
        return links
    wanted = F.filter(links, lambda x: ~x["href"].rlike("(?i)^(file|javascript):"))
    hrefs = F.transform(wanted, lambda x: x["href"])
    first = F.filter(wanted, lambda x, i: F.array_position(hrefs, x["href"]) == i + 1)
    texts = F.transform(first, lambda x: x["text"])
    return F.filter(first, lambda x, i: F.size(F.array_remove(F.transform(F.slice(texts, i + 2, F.greatest(F.size(texts), F.lit(1))), lambda t: t == x["text"]), False)) == 0)


def formatted(pages: DataFrame, options: ReadOptions | None = None) -> DataFrame:
    """The whole read as one plan: filters, one kernel pass with the outputs that the options need, then expressions.

    pages: page_id, url, href, html, status, status_text, is_intermediate, is_from_cache. Kernels that no output needs don't run.
    """
    o = options or ReadOptions()
    parts = set(o.respond_with.split("+"))
    if o.with_iframe or o.with_shadow_dom:
        raise OptionError("frames and shadow trees aren't part of the pages' markup")
    if o.assert_status is not None:
        pages = pages.withColumn("assertion", F.when(F.col("status") != o.assert_status, F.lit("AssertionFailure")))
    want = {"title", "description", "metadata"}
    want |= {"markdown"} if parts & {"content", "markdown", "frontmatter"} else set()
    want |= {"text"} if "text" in parts else set()
    want |= {"links"} if o.with_links_summary else set()
    want |= {"images"} if o.with_images_summary else set()
    base = F.coalesce("href", "url") if o.base == "final" else F.col("url")
    read = read_pages(pages.withColumn("base_url", base), tuple(want), o.renderer(), list(o.target_selector) or None, list(o.remove_selector) or None, url="base_url", content_only="content" in parts)
    out = read.withColumn("published_time", F.element_at(F.col("metadata")["article:published_time"], 1)).withColumn("status_warning", markup.status_warning(F.col("status"), F.col("status_text")))
    links = links_summary(F.col("links"), o.with_links_summary) if o.with_links_summary else None
    images = markup.images_summary(F.col("images")) if o.with_images_summary else None
    if "markdown" in want:
        if o.max_tokens is not None:
            out = out.withColumn("markdown", trimmed_to_tokens(F.col("markdown"), o.max_tokens))
        out = out.withColumn("tokens", estimated_tokens(F.col("markdown")))
        thin = markup.thin_warnings(F.col("tokens"), F.col("is_intermediate"), F.lit(False), F.col("is_from_cache"), F.col("html"))
        out = out.withColumn("warning", F.concat_ws("\n", "status_warning", F.nullif(thin, F.lit(""))))
        chunks = None
        if o.markdown_chunking and (strategy := parse_strategy(o.markdown_chunking)):
            out = out.withColumn("chunks", chunk(F.col("markdown"), *strategy, F.col("title")))
            chunks = F.col("chunks")
        if o.token_budget is not None:
            out = out.withColumn("budget_error", F.when(F.col("tokens") > o.token_budget, F.lit("BudgetExceeded")))
        if "frontmatter" in parts:
            out = out.withColumn("representation", markup.front_matter(F.col("title"), F.col("description"), F.col("url"), F.col("published_time"), F.col("warning"), F.col("markdown"), images, links))
        else:
            out = out.withColumn("representation", markup.plain_representation(F.col("title"), F.col("url"), F.col("published_time"), F.col("warning"), F.lit(None), F.col("markdown"), images, links, chunks=chunks))
    elif parts & {"html", "text"}:
        out = out.withColumn("representation", F.col("html") if "html" in parts else F.col("text"))
    return out.drop("status_warning", "base_url")


def with_options(o: ReadOptions, **changes: object) -> ReadOptions:
    return replace(o, **changes)
