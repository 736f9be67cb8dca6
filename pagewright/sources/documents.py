"""Sources besides HTML: decoding blobs, feeds and sitemaps, spreadsheets, office files, books, and PDF text; stdlib only."""

from __future__ import annotations

import csv
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from html import escape
from statistics import fmean, pstdev
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.kernel.render import RenderOptions, to_markdown
from pagewright.kernel.tree import parse_html
from pagewright.storage import provide_package

MAX_TEXT = 32 << 20
# Types by extension.
MIME = {
    "html": "text/html", "htm": "text/html", "xhtml": "application/xhtml+xml", "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "json": "application/json", "xml": "application/xml", "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "odt": "application/vnd.oasis.opendocument.text", "ods": "application/vnd.oasis.opendocument.spreadsheet", "odp": "application/vnd.oasis.opendocument.presentation", "epub": "application/epub+zip", "rtf": "application/rtf",
    "doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml",
}
SUPPORTED = frozenset(["csv", "docx", "xlsx", "pptx", "odt", "ods", "odp", "epub", "rtf", "pdf", "html", "htm", "xhtml", "txt", "md", "json", "xml"])


def mime_of(name: str, given: str | None = None) -> str:
    """The given type unless it says nothing, else the one of the extension."""
    if given and given != "application/octet-stream":
        return given.split(";")[0].strip().lower()
    return MIME.get(name.rpartition(".")[2].lower(), "application/octet-stream")


def decode_html(content: bytes, charset: str | None = None) -> str:
    """Text of an HTML blob: by its header's charset, else UTF-8; a charset in its first 1,024 characters counts if it fits better."""
    def attempt(name: str | None) -> str | None:
        try:
            return content.decode(name or "utf-8", "replace")
        except LookupError:
            return None

    text = attempt(charset) or attempt("utf-8")
    if "�" in text or (charset and charset.lower() not in ("utf-8", "utf8")):
        found = re.search(r"<meta[^>]+charset=[\"']?([\w-]+)", text[:1024], re.I)
        if found and (other := attempt(found[1])) and "�" not in other:
            return other
    return text


def text_page(text: str) -> str:
    return f"<html><body><pre>{escape(text, quote=False)}</pre></body></html>"


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _child(e: ElementTree.Element, *names: str) -> str:
    return next(("".join(c.itertext()).strip() for n in names for c in e if _local(c) == n), "")


def parse_feed(xml: str) -> tuple[str, list[dict]] | None:
    """(kind, entries) of RSS, Atom, a sitemap or its index; None for other XML. entries: title, link, description, date."""
    try:
        root = ElementTree.fromstring(xml.encode("utf-8") if not xml.lstrip().startswith("<?xml") else re.sub(r"^\s*<\?xml[^>]*\?>", "", xml))
    except ElementTree.ParseError:
        return None
    kind = _local(root)
    entry = lambda e, **k: {n: _child(e, *names.split()) for n, names in k.items()}
    if kind == "rss":
        return kind, [entry(i, title="title", link="link", description="description", date="pubDate") for i in root.iter() if _local(i) == "item"]
    if kind == "feed":
        rows = []
        for e in (e for e in root if _local(e) == "entry"):
            link = next((c.get("href", "") for c in e if _local(c) == "link" and c.get("rel", "alternate") == "alternate"), "")
            rows.append(entry(e, title="title", description="summary content", date="published updated") | {"link": link})
        return kind, rows
    if kind in ("urlset", "sitemapindex"):
        return kind, [{"title": "", "description": "", "link": _child(e, "loc"), "date": _child(e, "lastmod")} for e in root if _local(e) in ("url", "sitemap")]
    return None


def feed_page(xml: str) -> str:
    """A feed or sitemap as a page of links; other XML as text."""
    found = parse_feed(xml)
    if found is None:
        return text_page(xml)
    rows = "".join(f'<li><a href="{escape(e["link"])}">{escape(e["title"] or e["link"])}</a> {escape(e["date"])}<p>{escape(e["description"])}</p></li>' for e in found[1])
    return f"<html><body><ul>{rows}</ul></body></html>"


def grid_markdown(rows: list[list[str]]) -> str:
    """Rows as a table with the first one as its head."""
    rows = [[re.sub(r"\s+", " ", str(c)).strip().replace("|", "\\|") for c in r] for r in rows if any(str(c).strip() for c in r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda r: f"| {' | '.join(r + [''] * (width - len(r)))} |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])


def csv_markdown(text: str) -> str:
    try:
        dialect = csv.Sniffer().sniff(text[:4096], ",;\t|")
    except csv.Error:
        dialect = csv.excel
    return grid_markdown(list(csv.reader(io.StringIO(text), dialect)))


def _docx(z: zipfile.ZipFile) -> str:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    out = []
    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    text_of = lambda p: "".join(t.text or "" if t.tag == f"{w}t" else "\t" if t.tag == f"{w}tab" else "" for t in p.iter())
    for e in body if body is not None else []:
        if e.tag == f"{w}p":
            style = next((s.get(f"{w}val", "") for s in e.iter(f"{w}pStyle")), "")
            level = re.search(r"(?i)heading(\d)|^(title)$", style)
            text = text_of(e).strip()
            if text:
                out.append(f"{'#' * min(6, int(level[1] or 1))} {text}" if level else f"*   {text}" if e.find(f".//{w}numPr") is not None else text)
        elif e.tag == f"{w}tbl":
            out.append(grid_markdown([["".join(text_of(p) for p in c.iter(f"{w}p")) for c in r.iter(f"{w}tc")] for r in e.iter(f"{w}tr")]))
    return "\n\n".join(out)


def _xlsx(z: zipfile.ZipFile) -> str:
    s = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    shared = ["".join(t.text or "" for t in si.iter(f"{s}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    out = []
    for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        rows = []
        for r in ElementTree.fromstring(z.read(name)).iter(f"{s}row"):
            cells = []
            for c in r.iter(f"{s}c"):
                value = c.findtext(f"{s}v") or "".join(t.text or "" for t in c.iter(f"{s}t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            rows.append(cells)
        out.append(grid_markdown(rows))
    return "\n\n".join(x for x in out if x)


def _slides(z: zipfile.ZipFile) -> str:
    a = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    pages = [[x for p in ElementTree.fromstring(z.read(n)).iter(f"{a}p") if (x := "".join(t.text or "" for t in p.iter(f"{a}t")).strip())] for n in names]
    return "\n\n".join("\n\n".join([f"## {p[0]}", *p[1:]]) for p in pages if p)


def _opendocument(z: zipfile.ZipFile) -> str:
    out: list[str] = []
    for e in ElementTree.fromstring(z.read("content.xml")).iter():
        name = _local(e)
        text = "".join(e.itertext()).strip()
        if name == "h" and text:
            level = next((v for k, v in e.attrib.items() if k.endswith("outline-level")), "1")
            out.append(f"{'#' * min(6, int(level))} {text}")
        elif name == "table":
            out.append(grid_markdown([["".join(c.itertext()) for c in r if _local(c).endswith("table-cell")] for r in e.iter() if _local(r) == "table-row"]))
        elif name == "p" and text and not any(text in x for x in out[-1:] if x.startswith("|")):
            out.append(text)
    return "\n\n".join(out)


def _epub(z: zipfile.ZipFile) -> str:
    container = ElementTree.fromstring(z.read("META-INF/container.xml"))
    package = next(e.get("full-path") for e in container.iter() if _local(e) == "rootfile")
    opf, folder = ElementTree.fromstring(z.read(package)), package.rpartition("/")[0]
    items = {e.get("id"): e.get("href") for e in opf.iter() if _local(e) == "item"}
    spine = [items[e.get("idref")] for e in opf.iter() if _local(e) == "itemref" and e.get("idref") in items]
    pages = [z.read(f"{folder}/{h}" if folder else h).decode("utf-8", "replace") for h in spine]
    return "\n\n".join(to_markdown(parse_html(p), RenderOptions(drop_irrelevant=True, omit_head=True))[0] for p in pages)


def rtf_text(text: str) -> str:
    text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\u(-?\d+)\s?\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\(?:par|line)\b ?", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", text)).strip()


def pdf_pages(content: bytes) -> list[list[dict]]:
    """Text items (text, height) of each page that a PDF holds in plain or deflated streams with literal or hex strings."""
    pages = []
    for m in re.finditer(rb"<<(.{0,2000}?)>>\s*stream\r?\n(.*?)\r?\nendstream", content, re.S):
        body = m[2]
        if b"FlateDecode" in m[1]:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        items, height = [], 12.0
        for t in re.finditer(rb"/\S+\s+([\d.]+)\s+Tf|\((?P<s>(?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|<(?P<h>[0-9A-Fa-f\s]+)>\s*Tj|\[(?P<a>(?:\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ", body):
            if t[1]:
                height = float(t[1])
            else:
                raw = t["s"] if t["s"] is not None else bytes.fromhex(re.sub(rb"\s", b"", t["h"]).decode()) if t["h"] is not None else b"".join(re.findall(rb"\(((?:\\.|[^\\()])*)\)", t["a"] or b""))
                text = re.sub(rb"\\([nrtbf()\\])", lambda x: {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(x[1], x[1]), raw).decode("utf-16" if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else "latin-1", "replace")
                items.append({"text": text, "height": height})
        pages.append(items)
    return pages


def layout_markdown(pages: list[list[dict]]) -> str:
    """Lines of a paged document, with headings where letters are far higher than the document's mean, weighted by characters."""
    heights = [i["height"] for p in pages for i in p for _ in i["text"]]
    if not heights:
        return ""
    mean, spread = fmean(heights), pstdev(heights)
    out = []
    for p in pages:
        for i in p:
            text = i["text"].strip()
            if text:
                out.append(f"# {text}" if spread and i["height"] > mean + 3 * spread else f"## {text}" if spread and i["height"] > mean + 2 * spread else text)
    return "\n\n".join(out)


def document_markdown(name: str, content: bytes, mime: str | None = None) -> tuple[str | None, str | None]:
    """(markdown, error) of a file. Never raises."""
    kind = mime_of(name, mime)
    ext = next((e for e, m in MIME.items() if m == kind), name.rpartition(".")[2].lower())
    try:
        if ext in ("docx", "xlsx", "pptx", "odt", "ods", "odp", "epub"):
            reader = {"docx": _docx, "xlsx": _xlsx, "pptx": _slides, "epub": _epub}.get(ext, _opendocument)
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                return reader(z), None
        if ext == "pdf":
            return layout_markdown(pdf_pages(content)), None
        if ext not in SUPPORTED and not kind.startswith("text/"):
            return None, f"{ext or kind} is not supported"
        if len(content) > MAX_TEXT:
            return None, "the text is too large"
        text = decode_html(content)
        if ext == "csv":
            return csv_markdown(text), None
        if ext == "rtf":
            return rtf_text(text), None
        if ext == "md":
            return text, None
        page = text if ext in ("html", "htm", "xhtml") else feed_page(text) if ext == "xml" else text_page(text)
        return to_markdown(parse_html(page), RenderOptions(drop_irrelevant=True))[0], None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, StopIteration, UnicodeError, RecursionError) as e:
        return None, f"{type(e).__name__}: {e}"[:300]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest, markdown, error) of every file below a path."""
    provide_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [document_markdown(p, bytes(c)) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "digest": b["digest"], "markdown": [m for m, _ in made], "error": [e for _, e in made]}, dtype=object)

    return files.select("path", F.sha2("content", 256).alias("digest"), "content").mapInPandas(run, "path string, digest string, markdown string, error string")


def feed_entries(feeds: DataFrame, column: str = "body") -> DataFrame:
    """A row for each entry of each feed or sitemap, with the feed's other columns."""
    provide_package(feeds.sparkSession)

    @F.pandas_udf("array<struct<title:string,link:string,description:string,date:string>>")
    def entries(body: pd.Series) -> pd.Series:
        return pd.Series([(found[1] if t and (found := parse_feed(t)) else []) for t in body])

    return feeds.withColumn("_e", F.explode(entries(F.col(column)))).select(*(c for c in feeds.columns if c != column), "_e.*")
