"""Column expressions on options, markdown and represented pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for true and false.
FALSE_WORDS = ["", "false", "none", "null", "nan", "nil", "0", "no", "undefined", "disabled", "f", "n/a"]
TRUE_WORDS = ["true", "yes", "1", "ok", "enabled", "t"]


def pseudo_bool(text: Column, strict: bool = True) -> Column:
    """Truth of a word; null is false. strict: null... an unknown word is an error, else it is true."""
    word = F.lower(F.trim(text))
    unknown = F.raise_error(F.concat(F.lit("Cannot convert "), text, F.lit(" to boolean"))).cast("boolean") if strict else F.lit(True)
    return F.when(text.isNull() | word.isin(FALSE_WORDS), False).when(word.isin(TRUE_WORDS), True).otherwise(unknown)


def pseudo_bool_or_null(text: Column) -> Column:
    """As strict `pseudo_bool`, with null instead of an error."""
    word = F.lower(F.trim(text))
    return F.when(text.isNull() | word.isin(FALSE_WORDS), False).when(word.isin(TRUE_WORDS), True)


def tidy_markdown(text: Column) -> Column:
    """Links and images broken over lines put together, blank lines collapsed, leading blanks stripped."""
    out = F.regexp_replace(text, r"\[\s*\n+\s*([^\[\]\n]+?)\s*\n+\s*\]\(", "[$1](")
    out = F.regexp_replace(out, r"\]\s*\n+\s*\((https?://)", "]($1")
    out = F.regexp_replace(out, r"\]\(\s*([^\s()]+)\s*\)", "]($1)")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(out, r"(?m)^[ \t]+", ""))


def clean_attribute(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"(\n+\s*)+", "\n"), F.lit(""))


def squeeze_lines(text: Column) -> Column:
    """Blank lines only behind lines that aren't."""
    lines = F.split(text, "\n")
    keep = F.filter(F.arrays_zip(lines.alias("line"), F.concat(F.array(F.lit("")), lines).alias("last")), lambda x: (F.trim(x["line"]) != "") | (F.trim(x["last"]) != ""))
    return F.array_join(F.transform(keep, lambda x: x["line"]), "\n")


def json_quoted(text: Column) -> Column:
    """A JSON string of the text."""
    return F.regexp_replace(F.to_json(F.struct(text.alias("x"))), r'^\{"x":(.*)\}$', "$1")


def front_matter(title: Column, description: Column, url: Column, published: Column, warning: Column, content: Column, images: Column | None = None, links: Column | None = None) -> Column:
    """Quoted fields between rules, the content, and lists of images and links if asked; empty fields are left out."""
    fields = [("title", title), ("description", description), ("url", url), ("publishedTime", published), ("warning", warning)]
    head = F.concat_ws("\n", F.lit("---"), *(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), json_quoted(c))) for name, c in fields), F.lit("---"))
    lists = _inventories("## Images", "## Links/Buttons", images, links)
    return F.concat(head, F.lit("\n\n"), F.coalesce(content, F.lit("")), F.when(lists != "", F.concat(F.lit("\n\n"), lists, F.lit("\n"))).otherwise(""))


def plain_representation(
    title: Column, url: Column, published: Column, warning: Column, pages: Column, content: Column, images: Column | None = None, links: Column | None = None, instead: list[Column] | None = None, chunks: Column | None = None
) -> Column:
    """Labelled fields, then the content, and lists of images and links if asked.

    instead: what stands for a page without content, in turn (addresses of shots with a line break, its html, its text). chunks: if
    there are any, they are the representation.
    """
    some = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    line = lambda label, c: F.when(some(c), F.concat(F.lit(f"{label}: "), c.cast("string")))
    warn = F.when(some(warning), F.concat(F.lit("Warning: "), F.replace(warning, F.lit("\n"), F.lit("\nWarning: "))))
    mixed = F.concat_ws("\n\n", line("Published Time", published), warn, F.when(pages.cast("int") != 0, line("Number of Pages", pages)))
    lists = _inventories("Images:", "Links/Buttons:", images, links)
    whole = F.concat(
        F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\n\nURL Source: "), F.coalesce(url, F.lit("")), F.lit("\n"), F.when(mixed != "", F.concat(F.lit("\n"), mixed, F.lit("\n"))).otherwise(""),
        F.lit("\nMarkdown Content:\n"), F.coalesce(content, F.lit("")), F.lit("\n"), F.when(lists != "", F.concat(F.lit("\n"), lists, F.lit("\n"))).otherwise(""),
    )
    if chunks is not None:
        whole = F.when(F.coalesce(F.size(chunks), F.lit(0)) > 0, F.array_join(chunks, "\n\n\u001d")).otherwise(whole)
    stand_in = F.coalesce(*(F.when(some(c), c) for c in instead), whole) if instead else whole
    return F.when(some(content), whole).otherwise(stand_in)


# What the lists of a page without images or links say.
NO_IMAGES, NO_LINKS = "This page does not seem to contain any images.", "This page does not seem to contain any buttons/links."


def _inventories(image_head: str, link_head: str, images: Column | None, links: Column | None) -> Column:
    out = []
    if images is not None:
        rows = F.transform(F.map_entries(images), lambda e: F.concat(F.lit("- !["), e["key"], F.lit("]("), F.coalesce(e["value"], F.lit("")), F.lit(")")))
        out.append(F.when(images.isNotNull(), F.array_join(F.concat(F.array(F.lit(image_head)), F.when(F.size(images) > 0, rows).otherwise(F.array(F.lit(NO_IMAGES)))), "\n")))
    if links is not None:
        rows = F.transform(links, lambda x: F.concat(F.lit("- ["), F.coalesce(x["text"], F.lit("")), F.lit("]("), F.coalesce(x["href"], F.lit("")), F.lit(")")))
        out.append(F.when(links.isNotNull(), F.array_join(F.concat(F.array(F.lit(link_head)), F.when(F.size(links) > 0, rows).otherwise(F.array(F.lit(NO_LINKS)))), "\n")))
    return F.concat_ws("\n\n", *out)


def images_summary(images: Column) -> Column:
    """Images of a page for its summary: the address of each by its number and alternative text, the first of each address."""
    sources = F.transform(images, lambda x: x["src"])
    first = F.filter(images, lambda x, i: F.array_position(sources, x["src"]) == i + 1)
    tag = lambda x, i: F.concat(F.lit("Image "), (i + 1).cast("string"), F.when(F.coalesce(x["alt"], F.lit("")) != "", F.concat(F.lit(": "), x["alt"])).otherwise(""))
    return F.map_from_arrays(F.transform(first, tag), F.transform(first, lambda x: x["src"]))


def status_warning(status: Column, text: Column) -> Column:
    """Warning for a status below 200 or from 400 on."""
    return F.when((status < 200) | (status >= 400), F.concat(F.lit("Target URL returned error "), status.cast("string"), F.lit(": "), F.coalesce(text, F.lit(""))))


# Warnings on thin pages.
THIN = {
    "intermediate": "This page maybe not yet fully loaded, consider explicitly specify a timeout.",
    "iframe": "This page contains iframe that are currently hidden, consider enabling iframe processing.",
    "captcha": "This page maybe requiring CAPTCHA, please make sure you are authorized to access this page.",
    "cached": "This is a cached snapshot of the original page, consider retry with caching opt-out.",
}


def thin_warnings(tokens: Column, intermediate: Column, iframe: Column, cached: Column, html: Column | None = None) -> Column:
    """Warnings on pages with fewer than 200 tokens."""
    challenge = F.lit(False) if html is None else html.contains("captcha") | html.contains("cf-turnstile-response")
    return F.concat_ws("\n", *(F.when((tokens < 200) & held, THIN[name]) for name, held in (("intermediate", intermediate), ("iframe", iframe), ("captcha", challenge), ("cached", cached))))


def token_charge(content: Column, description: Column, text: Column, html: Column, shots: Column, cap: int = 2_000_000) -> Column:
    """Tokens charged: content or description, text, html, and 765 for each screenshot, at most the cap."""
    some = lambda c: F.coalesce(c, F.lit(0))
    return F.least(F.lit(cap).cast("long"), (F.coalesce(content, description, F.lit(0)) + some(text) + some(html) + 765 * some(shots)).cast("long"))


def image_size_fit(width: Column, height: Column, box: int = 1024) -> Column:
    """(width, height) scaled down to a square box."""
    scale = F.least(F.lit(1.0), F.lit(float(box)) / F.greatest(width, height))
    return F.struct(F.round(width * scale).cast("int").alias("width"), F.round(height * scale).cast("int").alias("height"))


def sse_event(event: Column, data: Column, id_: Column | None = None, retry: Column | None = None) -> Column:
    """A server-sent event; data over several lines gets a field for each."""
    rows = F.transform(F.split(data, "\r?\n"), lambda x: F.concat(F.lit("data: "), x))
    return F.concat(F.concat_ws("\n", F.when(event.isNotNull(), F.concat(F.lit("event: "), event)), F.when(id_.isNotNull(), F.concat(F.lit("id: "), id_)) if id_ is not None else F.lit(None), F.when(retry.isNotNull(), F.concat(F.lit("retry: "), retry.cast("string"))) if retry is not None else F.lit(None), F.array_join(rows, "\n")), F.lit("\n\n"))


def sse_events(body: Column) -> Column:
    """Array of (event, data, id, retry) of a whole stream."""
    def field(block: Column, name: str) -> Column:
        values = F.regexp_extract_all(block, F.lit(rf"(?m)^{name}:[ ]?(.*)$"), F.lit(1))
        return F.when(F.size(values) > 0, F.array_join(values, "\n") if name == "data" else F.element_at(values, -1))

    blocks = F.filter(F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n\n+"), lambda b: b.rlike(r"(?m)^(event|data|id|retry):"))
    return F.transform(blocks, lambda b: F.struct(field(b, "event").alias("event"), field(b, "data").alias("data"), field(b, "id").alias("id"), field(b, "retry").try_cast("int").alias("retry")))


def pdf_time(text: Column) -> Column:
    """UTC time of a PDF date."""
    g = lambda i: F.regexp_extract(text, r"^D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:Z|([+-])(\d{2})'?(\d{2})?'?)?", i)
    full = F.concat(g(1), *(F.lpad(F.coalesce(F.nullif(g(i), F.lit("")), F.lit("01" if i < 4 else "00")), 2, "0") for i in range(2, 7)))
    sign = F.when(g(7) == "-", 1).when(g(7) == "+", -1).otherwise(0)
    minutes = sign * (F.coalesce(g(8).try_cast("int"), F.lit(0)) * 60 + F.coalesce(g(9).try_cast("int"), F.lit(0)))
    return F.timestamp_millis(F.unix_millis(F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss"))) + minutes * 60000)
