"""Answers and their parts: envelopes, result texts, negotiation, page selection, alternative texts, cookies, redirects, API rows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.kernel.css import select
from pagewright.kernel.tree import parse_html

# Fields of a result and their labels, in order.
RESULT_FIELDS = [("title", "Title"), ("link", "URL Source"), ("snippet", "Description"), ("date", "Date"), ("source", "Source"), ("image_url", "Image"), ("site_name", "Site Name"), ("published_time", "Published Time"), ("warning", "Warning"), ("num_pages", "Number of Pages")]
#: Rows of a search API's answer.
API_ROWS = "organic array<struct<title:string,link:string,snippet:string,date:string,position:int>>, news array<struct<title:string,link:string,snippet:string,date:string,source:string,imageUrl:string>>, images array<struct<title:string,link:string,imageUrl:string,source:string>>"


def json_envelope(data: Column, code: int = 200, status: int = 20000) -> Column:
    """{code, status, data} as JSON."""
    return F.to_json(F.struct(F.lit(code).alias("code"), F.lit(status).alias("status"), data.alias("data")))


def result_text(number: Column, columns: list[str]) -> Column:
    """Labelled lines of one search result; fields that are missing or empty are left out."""
    lines = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit("["), number.cast("string"), F.lit(f"] {label}: "), F.col(c).cast("string"))) for c, label in RESULT_FIELDS if c in columns]
    return F.concat_ws("\n", *lines)


def batch_answer(pages: DataFrame, order: str = "ord") -> DataFrame:
    """One text of all pages of a batch: (batch, answer). pages: batch, ord, url, content, error; a batch is a request's list of addresses."""
    block = F.concat(F.lit("### "), F.col("url"), F.lit(" ("), (F.col(order) + 1).cast("string"), F.lit(")\n\n"), F.when(F.col("error").isNotNull(), F.concat(F.lit("> Error: "), F.col("error"))).otherwise(F.coalesce("content", F.lit(""))))
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b"))))
    return pages.groupBy("batch").agg(F.array_join(F.transform(rows, lambda x: x["b"]), "\n\n---\n\n").alias("answer"))


def negotiate(accept: str | None) -> str:
    """Output mode of an Accept header: text wins, then event streams, else JSON."""
    kinds = {k.split(";")[0].strip() for k in (accept or "").lower().split(",")}
    return "text" if "text/plain" in kinds else "events" if "text/event-stream" in kinds else "json"


def compression(accept_encoding: str | None, size: int, threshold: int = 1024) -> str:
    """Encoding of an answer by q-values, zstd before br, gzip and deflate; small answers stay as they are."""
    if size < threshold or not accept_encoding:
        return "identity"
    q: dict[str, float] = {}
    for part in accept_encoding.lower().split(","):
        name, _, rest = part.strip().partition(";")
        m = re.search(r"q=([\d.]+)", rest)
        q[name.strip()] = float(m[1]) if m else 1.0
    order = ["zstd", "br", "gzip", "deflate"]
    best = max(order, key=lambda e: (q.get(e, q.get("*", 0.0)), -order.index(e)))
    weight = q.get(best, q.get("*", 0.0))
    return best if weight > 0 and weight >= q.get("identity", 0.0) else "identity"


def select_page(documents: DataFrame, frames: DataFrame) -> DataFrame:
    """Each document's frame of the page its address asks for (`#N`), else the whole. documents: digest, url, content; frames: digest, ord, content."""
    d = documents.withColumn("_page", F.regexp_extract("url", r"#(\d+)$", 1).try_cast("int"))
    f = frames.select(F.col("digest").alias("_digest"), F.col("ord").alias("_ord"), F.col("content").alias("_content"))
    out = d.join(f, (F.col("digest") == F.col("_digest")) & (F.col("_page") == F.col("_ord")), "left")
    return out.withColumn("content", F.coalesce("_content", "content")).drop("_page", "_digest", "_ord", "_content")


def page_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("digest").agg(F.count(F.lit(1)).alias("num_pages"))


def with_alt_texts(images: DataFrame, generated: DataFrame) -> DataFrame:
    """Images (page_id, src, alt), each address of a page once, with the generated text (src, generated_alt) where there is one."""
    return images.dropDuplicates(["page_id", "src"]).join(generated.select("src", "generated_alt"), "src", "left").withColumn("alt", F.coalesce("generated_alt", "alt")).drop("generated_alt")


def cookie_applies(domain: Column, path: Column, secure: Column, expires_at: Column, host: Column, url_path: Column, scheme: Column, now: Column) -> Column:
    """Whether a cookie goes with a request: not expired, host below its domain, path below its path, https if secure."""
    bare = F.regexp_replace(F.lower(domain), r"^\.", "")
    on_host = domain.isNull() | (F.lower(host) == bare) | F.lower(host).endswith(F.concat(F.lit("."), bare))
    below = F.coalesce(path, F.lit("/"))
    on_path = (url_path == below) | url_path.startswith(F.when(below.endswith("/"), below).otherwise(F.concat(below, F.lit("/"))))
    return (expires_at.isNull() | (expires_at > now)) & on_host & on_path & (~F.coalesce(secure, F.lit(False)) | (scheme == "https"))


def final_urls(fetches: DataFrame, most: int = 6) -> DataFrame:
    """(url, final_url, n_hops) of chains of redirects: fetches has url, status and location, a row for each address.

    A chain takes as many joins as it may have hops, whatever the number of rows.
    """
    moves = fetches.filter(F.col("status").isin(301, 302, 303, 307, 308) & F.col("location").isNotNull()).select(F.col("url").alias("_from"), F.col("location").alias("_to"))
    out = fetches.select("url", F.col("url").alias("final_url"), F.lit(0).alias("n_hops"))
    for _ in range(most):
        out = out.join(moves, F.col("final_url") == F.col("_from"), "left").select("url", F.coalesce("_to", "final_url").alias("final_url"), (F.col("n_hops") + F.col("_to").isNotNull().cast("int")).alias("n_hops"))
    return out


def api_results(answers: DataFrame, body: str = "body") -> DataFrame:
    """(query_digest, variant, rank, link, title, snippet, date) of a search API's JSON answers."""
    read = answers.withColumn("_b", F.from_json(F.col(body), API_ROWS))
    null = F.lit(None).cast("string")

    def rows(variant: str, snippet: bool) -> DataFrame:
        part = read.select("query_digest", F.posexplode(F.col(f"_b.{variant}")).alias("rank", "r"))
        return part.select("query_digest", F.lit({"organic": "web"}.get(variant, variant)).alias("variant"), "rank", "r.link", "r.title", (F.col("r.snippet") if snippet else null).alias("snippet"), (F.col("r.date") if snippet else null).alias("date"))

    return rows("organic", True).unionByName(rows("news", True)).unionByName(rows("images", False))


def html_results(pages: DataFrame, item: str = "li.result", link: str = "a") -> DataFrame:
    """(query_digest, rank, link, title) of result pages, by selectors of an item and of its link."""
    @F.pandas_udf("array<struct<link:string,title:string>>")
    def extract(html: pd.Series) -> pd.Series:
        out = []
        for h in html:
            found = [next(iter(select(i, link)), None) for i in select(parse_html(h or ""), item)]
            out.append([{"link": a.attrs["href"], "title": " ".join(a.raw_text().split())} for a in found if a is not None and a.attrs.get("href")])
        return pd.Series(out)

    return pages.select("query_digest", F.posexplode(extract("html")).alias("rank", "r")).select("query_digest", "rank", "r.link", "r.title")
