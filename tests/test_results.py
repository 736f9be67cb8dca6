"""Envelopes, negotiation, selection, cookies, redirects and result rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from pagewright.operators import results


def test_negotiation() -> None:
    assert [results.negotiate(a) for a in ("text/plain, application/json", "text/event-stream", "*/*", None)] == ["text", "events", "json", "json"]
    assert results.compression("gzip, br;q=0.9", 5000) == "gzip"
    assert results.compression("gzip, zstd", 5000) == "zstd"
    assert results.compression("gzip", 10) == results.compression(None, 5000) == results.compression("identity, gzip;q=0.5", 5000) == "identity"


def test_tables(spark) -> None:  # noqa: ANN001
    docs = spark.createDataFrame([("d", "u#2", "whole"), ("d", "u", "whole"), ("e", "u#9", "whole")], "digest string, url string, content string")
    frames = spark.createDataFrame([("d", 1, "one"), ("d", 2, "two")], "digest string, ord int, content string")
    assert sorted(r["content"] for r in results.select_page(docs, frames).collect()) == ["two", "whole", "whole"]
    assert results.page_counts(frames).first()["num_pages"] == 2
    fetches = spark.createDataFrame([("a", 301, "b"), ("b", 302, "c"), ("c", 200, None)], "url string, status int, location string")
    assert {tuple(r) for r in results.final_urls(fetches).collect()} == {("a", "c", 2), ("b", "c", 1), ("c", "c", 0)}
    answers = spark.createDataFrame([("q", '{"organic":[{"title":"t","link":"l","snippet":"s"}],"images":[{"title":"i","link":"m"}]}')], "query_digest string, body string")
    assert {(r["variant"], r["link"]) for r in results.api_results(answers).collect()} == {("web", "l"), ("images", "m")}
    pages = spark.createDataFrame([("q", "<ul><li class=result><a href=u>A  b</a><li class=ad><a href=x>x</a></ul>"), ("r", None)], "query_digest string, html string")
    assert [tuple(r) for r in results.html_results(pages).collect()] == [("q", 0, "u", "A b")]
    batch = spark.createDataFrame([("b", 1, "v", None, "bad"), ("b", 0, "u", "text", None)], "batch string, ord int, url string, content string, error string")
    assert results.batch_answer(batch).first()["answer"] == "### u (1)\n\ntext\n\n---\n\n### v (2)\n\n> Error: bad"
    images = spark.createDataFrame([(1, "s", "a"), (1, "s", "a"), (1, "t", "b")], "page_id int, src string, alt string")
    alts = spark.createDataFrame([("s", "g")], "src string, generated_alt string")
    assert sorted(r["alt"] for r in results.with_alt_texts(images, alts).collect()) == ["b", "g"]
    assert json.loads(docs.limit(1).select(results.json_envelope(F.struct("url")).alias("x")).first()["x"])["code"] == 200
    lit, none = F.lit, F.lit(None).cast("timestamp")
    cookie = lambda host, path, scheme: spark.range(1).select(results.cookie_applies(lit(".a.b"), lit("/p"), lit(True), none, lit(host), lit(path), lit(scheme), F.current_timestamp()).alias("x")).first()["x"]
    assert cookie("x.a.b", "/p/q", "https") and not cookie("xa.b", "/p", "https") and not cookie("a.b", "/pq", "https") and not cookie("a.b", "/p", "http")
    row = spark.createDataFrame([("T", "L", None)], "title string, link string, date string")
    assert row.select(results.result_text(lit(1), row.columns).alias("x")).first()["x"] == "[1] Title: T\n[1] URL Source: L"
