"""Column functions, kernels of JSON, documents and times, and plans on small tables."""

from __future__ import annotations

import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright.functions import markup, urls
from pagewright.functions.text import site_of
from pagewright.kernel import jsontext
from pagewright.kernel.ip import in_cidr, is_non_public
from pagewright.kernel.timeparse import local_to_utc, readings
from pagewright.operators import chain, chunks, policy, prompts, search, timestamps
from pagewright.operators.pages import trimmed_to_tokens
from pagewright.plans.options import OptionError, ReadOptions, formatted, from_headers
from pagewright.sources.documents import csv_markdown, decode_html, document_markdown, parse_feed, pdf_pages
from pagewright.streaming import observations

ZONES = {"CET": 60, "EST": -300}


@pytest.mark.parametrize(("value", "order", "ms"), [
    ("2021-01-02T00:00:01Z", "", 1609545601000), ("2021-01-02T01:00:01+01:00[Europe/Paris]", "", 1609545601000), ("1609545601", "", 1609545601000), ("1609545601000123", "", 1609545601000), ("Sat, 02 Jan 2021 00:00:01 GMT", None, None),
    ("D:20210102010001+01'00'", "", 1609545601000), ("20210102T000001Z", "", 1609545601000), ("2. Januar 2021, 00:00 Uhr", "", 1609545600000), ("2021年1月2日 0時00分", "", 1609545600000), ("January 2, 2021 1:00 am CET", "", 1609545600000),
    ("Saturday, 02-Jan-21 01:00:00 CET", "", 1609545600000), ("Sat Jan  2 00:00:00 2021", "", 1609545600000), ("2 de enero de 2021, 00:00", "", 1609545600000), ("2 января 2021 г., 00:00", "", 1609545600000), ("2 janvier 2021 à 00h00", "", 1609545600000),
])
def test_readings(value: str, order: str | None, ms: int | None) -> None:
    found = readings(value, ZONES)
    assert (not found) if ms is None else [m for _, m, _ in found] == [ms] and found[0][0].partition("/")[2] not in timestamps.ORDERS


def test_readings_open_order_and_none() -> None:
    assert {n for n, _, _ in readings("03/04/2021 10:00", ZONES)} == {"numbers/DMY", "numbers/MDY"}
    assert {n for n, _, _ in readings("30/04/2021 10:00", ZONES)} == {"numbers/DMY"}
    assert readings("vor 2 Wochen", ZONES)[0][1] == -1209600000
    for value in (None, "", "soon", "2023-02-30", "2024-13-05T10:00:00Z", "0000-00-00", "x" * 5000, "2021-01-01 25:00"):
        assert readings(value, ZONES) == []


def test_local_times() -> None:
    assert local_to_utc(1609545600000, "Europe/Berlin") == 1609542000000
    assert local_to_utc(1635645600000, "Europe/Berlin") is None  # 2021-10-31 02:00 occurs twice
    assert local_to_utc(1616898600000, "Europe/Berlin") is None  # 2021-03-28 02:30 never
    assert local_to_utc(0, "No/Where") is None


def test_mixture_decides() -> None:
    """The order comes from values that only one order can read; a declared one tips what they leave open."""
    open_, day, month = ("n/DMY", "n/MDY"), ("n/DMY",), ("n/MDY",)
    share = timestamps.fit_notations({day: 50, open_: 100, ("iso",): 30}, None)
    assert share["n/DMY"] > 100 * share["n/MDY"] and share["iso"] == pytest.approx(30 / 180, abs=0.01)
    both = timestamps.fit_notations({open_: 100}, None)
    assert both["n/DMY"] == pytest.approx(both["n/MDY"], rel=0.01)
    declared = timestamps.fit_notations({open_: 100}, "MDY")
    assert declared["n/MDY"] > 100 * declared["n/DMY"]
    against = timestamps.fit_notations({day: 500, open_: 500}, "MDY")
    found = [{"notation": "n/DMY", "ms": 1, "off": None}, {"notation": "n/MDY", "ms": 2, "off": None}]
    assert timestamps.chosen(found, against) is None  # the data contradict the declaration
    mixed = timestamps.fit_notations({day: 50, month: 50, open_: 100}, None)
    found = [{"notation": "n/DMY", "ms": 1, "off": None}, {"notation": "n/MDY", "ms": 2, "off": None}]
    assert timestamps.chosen(found, mixed) is None and timestamps.chosen(found, share)["ms"] == 1
    assert timestamps.chosen(found[1:], share) is None and timestamps.chosen(found[1:], mixed)["ms"] == 2


def test_normalise_times(spark) -> None:  # noqa: ANN001
    rows = [(1, "03/04/2021 10:00", "a", "UTC", "DMY", None), (2, "03/04/2021 10:00", "a", "UTC", "DMY", None), (3, None, "a", "UTC", "DMY", None), (4, "", None, None, None, None), (5, "3/4/2021", "u", "UTC", None, None), (6, "2 hours ago", "a", "UTC", None, 7200000), (7, "2 hours ago", "a", "UTC", None, None), (8, "2021-01-01", "a", None, None, None), (9, "x" * 100000, "a", "UTC", None, None)]
    df = spark.createDataFrame(rows, "record_id long, value string, source string, zone string, declared_order string, fetched_ms long").withColumn("utc_ms", F.lit("clash"))
    got = {r["record_id"]: (r["utc_ms"], r["status"]) for r in timestamps.normalise_times(df, ZONES).collect()}
    assert got[1] == got[2] == (1617444000000, "resolved")
    assert got[3][1] == got[4][1] == got[9][1] == "none"
    assert got[5] == (None, "ambiguous order")
    assert got[6] == (0, "resolved")
    assert got[7] == (None, "no fetch time")
    assert got[8] == (None, "ambiguous local time")
    assert timestamps.normalise_times(df.limit(0), ZONES).count() == 0


def test_json() -> None:
    assert jsontext.parse_tolerant('{"a": [1, -2.5e-3, "x\\u00e9", true, null]}') == {"a": [1, -0.0025, "xé", True, None]}
    assert jsontext.parse_tolerant('noise {"a": 1', contaminated=True, abrupt=True) == {"a": 1}
    assert jsontext.parse_tolerant("[TRUE, Null]", literal_case=True) == [True, None]
    assert jsontext.parse_tolerant('{"a": 1, b}', swallow=True) == {"a": 1}
    for bad in ("01", "-", "1.", '"\n"', '{"a":}', "[1,]x", "tru", '"\\q"'):
        with pytest.raises(jsontext.JsonError):
            jsontext.parse_tolerant(bad)
    assert jsontext.focus({"a": {"b": [{"c": 3}]}}, "a.b[0].c") == 3
    assert jsontext.offsets('{"é": [1, 22]}', ("é", 1)) == (10, 12, 11, 13)
    assert jsontext.escape_newlines('{"a": "x\ny"}\n') == '{"a": "x\\ny"}\n'


def test_event_stream_in_pieces() -> None:
    text, stream, out = "event: a\r\ndata: 1\r\ndata: 2\r\n\r\nid: 7\nretry: 5\ndata: {}\n\n", jsontext.EventStream(), []
    for c in text:
        out += stream.feed(c)
    assert out == [{"event": "a", "data": "1\n2"}, {"id": "7", "retry": 5, "data": "{}"}]


def test_addresses() -> None:
    assert is_non_public("::ffff:10.0.0.1") and not is_non_public("8.8.8.8") and is_non_public("fe80::1") and is_non_public("x") is None
    assert in_cidr("10.1.2.3", "10.0.0.0/8") and not in_cidr("::1", "10.0.0.0/8")


def test_columns(spark) -> None:  # noqa: ANN001
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert one(site_of(lit("HTTPS://u@WWW.Exa.com:8080/p"))) == "exa.com"
    assert one(site_of(lit("nothing"))) is None
    assert one(urls.with_scheme(lit("//a.b"))) == "https://a.b"
    assert one(urls.attempt_url_fix(lit("https://https://a.b"))) == "https://a.b"
    assert one(urls.url_digest(lit("HTTP://A/b#c"))) == one(urls.url_digest(lit("http://a/b")))
    assert one(urls.search_target(lit("https://d/?uddg=https%3A%2F%2Fa.b%2Fc"))) == "https://a.b/c"
    assert one(urls.video_canonical(lit("//www.youtube.com/embed/x1"))) == "https://www.youtube.com/watch?v=x1"
    assert one(urls.registrable_domain(lit("a.b.co.uk"))) == "b.co.uk"
    assert one(urls.non_public_ipv4(lit("172.16.3.4"))) and one(urls.ipv4_in_cidr(lit("10.2.3.4"), lit("10.0.0.0/8"))) and one(urls.ipv4_number(lit("1.2.3.400"))) is None
    assert one(markup.pseudo_bool(lit(" No "))) is False and one(markup.pseudo_bool(lit("what"), strict=False)) is True
    assert one(markup.squeeze_lines(lit("a\n\n\nb"))) == "a\n\nb"
    assert one(markup.tidy_markdown(lit("a\n\n\n\n  b"))) == "a\n\nb"
    assert one(markup.json_quoted(lit('a"b\n'))) == '"a\\"b\\n"'
    assert one(markup.sse_event(lit("e"), lit("1\n2"))) == "event: e\ndata: 1\ndata: 2\n\n"
    assert [tuple(r) for r in one(markup.sse_events(lit("data: 1\ndata: 2\n\nevent: e\nretry: 3\n\n")))] == [(None, "1\n2", None, None), ("e", None, None, 3)]
    assert str(one(markup.pdf_time(lit("D:20210102030405+01'00'")))) == "2021-01-02 02:04:05"
    assert one(markup.status_warning(lit(404), lit("Not Found"))).endswith("404: Not Found")
    md = "intro\n# A\na\n## B\nb\n# C\nc"
    assert one(chunks.chunk(lit(md), 1)) == ["intro", "# A\na\n\n## B\nb", "# C\nc"]
    assert one(chunks.chunk(lit(md), 2, True, lit("T"))) == ["intro", "# T\n# A\n\na", "# T\n# A\n## B\n\nb", "# T\n# C\n\nc"]
    assert [r["parents"] for r in one(chunks.heading_nodes(lit(md)))] == [[], [], ["# A"], []]
    many = "".join(f"\n{'#' * (i % 4 + 1)} H{i}\ntext {i}" for i in range(800))
    began = time.time()
    assert len(one(chunks.chunk(lit(many), 4, True, lit("T")))) == 800 + 1 and time.time() - began < 20
    assert one(search.relevant(lit("Café 北京"), lit("t"), lit("im café"), lit("http://x"))) and not one(search.relevant(lit("zebra"), lit("t"), lit("s"), lit("http://x?q=zebra")))


def test_robots(spark) -> None:  # noqa: ANN001
    body = "User-agent: a\nDisallow: /x*y\nAllow: /p\nDisallow: /\nUser-agent: b\nDisallow:"
    robots = spark.createDataFrame([("o", body)], "origin string, body string")
    requests = spark.createDataFrame([(1, "o", "/x1y", "A"), (2, "o", "/p/q", "a"), (3, "o", "/z", "a"), (4, "o", "/z", "b"), (5, "none", "/z", "a")], "request_id long, origin string, path string, agent string")
    assert {r["request_id"]: r["allowed"] for r in policy.robots_verdict(requests, robots).collect()} == {1: False, 2: True, 3: False, 4: True, 5: True}
    rules = spark.createDataFrame([("q", "Disallow: /a?\nDisallow: /b # c\nDisallow: /d*e$"), ("r", "Disallow: /\nUser-agent: x\nAllow: /")], "origin string, body string")
    asked = spark.createDataFrame([(1, "q", "/a", "z"), (2, "q", "/b", "z"), (3, "q", "/d1e", "z"), (4, "r", "/", "z")], "request_id long, origin string, path string, agent string")
    assert {r["request_id"]: r["allowed"] for r in policy.robots_verdict(asked, rules).collect()} == {1: False, 2: True, 3: True, 4: False}


def test_representations(spark) -> None:  # noqa: ANN001
    one = lambda c: spark.range(1).select(c).first()[0]
    null = F.lit(None).cast("string")
    links = F.array(F.struct(F.lit("a").alias("text"), F.lit("u").alias("href")))
    plain = one(markup.plain_representation(F.lit("T"), F.lit("u"), F.lit("2021"), F.lit("w\nx"), F.lit(2), F.lit("c"), None, links))
    assert plain == "Title: T\n\nURL Source: u\n\nPublished Time: 2021\n\nWarning: w\nWarning: x\n\nNumber of Pages: 2\n\nMarkdown Content:\nc\n\nLinks/Buttons:\n- [a](u)\n"
    assert one(markup.plain_representation(F.lit("T"), F.lit("u"), null, null, F.lit(None), F.lit("c"))) == "Title: T\n\nURL Source: u\n\nMarkdown Content:\nc\n"
    assert one(markup.plain_representation(F.lit("T"), F.lit("u"), null, null, F.lit(None), null, instead=[null, F.lit("<p>")])) == "<p>"
    empty = F.create_map().cast("map<string,string>")
    assert one(markup.front_matter(F.lit("T"), null, F.lit("u"), null, null, F.lit("c"), empty, links)) == '---\ntitle: "T"\nurl: "u"\n---\n\nc\n\n## Images\nThis page does not seem to contain any images.\n\n## Links/Buttons\n- [a](u)\n'
    images = F.array(*(F.struct(F.lit(s).alias("src"), F.lit(a).alias("alt")) for s, a in (("x", "A"), ("y", ""), ("x", "B"))))
    assert one(markup.images_summary(images)) == {"Image 1: A": "x", "Image 2": "y"}
    assert one(trimmed_to_tokens(F.lit("one two  three, four"), 3)) == "one two  three"


def test_timing(spark) -> None:  # noqa: ANN001
    lit, none = F.lit, F.lit(None)
    one = lambda c: spark.range(1).select(c).first()[0]
    presumed = lambda explicit=none, timeout=none, iframe=lit(False), respond=lit("content"), elapsed=none: one(observations.presumed_timing(explicit, timeout, iframe, respond, elapsed))
    assert presumed() == "resource-idle" and presumed(timeout=lit(20)) == presumed(iframe=lit(True), timeout=lit(3)) == "network-idle"
    assert presumed(timeout=lit(6)) == "resource-idle" and presumed(elapsed=lit(5001)) == "mutation-idle" and presumed(respond=lit("screenshot")) == "media-idle"
    seen = {k: none for k in ("media_loaded", "content_loaded", "mutation_idle", "parsed_content", "html", "pageshot", "screenshot", "is_intermediate")}
    accept = lambda timing, respond="content", wait=False, scripts=False, iframe=False, **x: one(observations.early_accept(lit(timing), lit(2000), {**seen, **{k: lit(v) for k, v in x.items()}}, lit(respond), lit(wait), lit(scripts), lit(iframe)))
    assert accept("html", html="<p>") and not accept("html", html="<p>", wait=True) and not accept("html", html="<p>", scripts=True)
    assert accept("resource-idle", content_loaded=1000, mutation_idle=1, is_intermediate=True) and not accept("resource-idle", content_loaded=1600, mutation_idle=1, is_intermediate=True)
    assert not accept("network-idle") and not accept("media-idle", respond="screenshot") and accept("mutation-idle", mutation_idle=1, is_intermediate=True)
    assert accept("resource-idle", is_intermediate=False) and not accept("resource-idle", is_intermediate=False, iframe=True)


def test_relaxation_and_alts(spark) -> None:  # noqa: ANN001
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(search.relaxed_queries(F.lit("a b c d e f g h"))) == ["a b c d e f g h", "a b c d e f", "a b c d", "a b"]
    assert one(search.relaxed_queries(F.lit("א ב ג ד"))) == ["א ב ג ד", "ב ג ד", "ג ד", "ד"] and one(search.relaxed_queries(F.lit("ก ข ค")))[1] == "ก ข"
    alt = lambda a, w, h: one(policy.image_alt_decision(F.lit(a).cast("string"), F.lit("G"), F.lit(w), F.lit(h)))
    assert (alt("A cat", 9, 9), alt("Figure", 100, 100), alt(None, 1, 5), alt("", 32, 90), alt("logo", 90, 90)) == ("A cat", "G", "A 1x5 image, likely be a tacker probe", "A 32x90 small image, likely a logo, icon or avatar", "logo")


def test_search_helpers() -> None:
    assert search.with_operators("q", site=["a", "b"], ext="pdf") == "q ext:pdf AND (site:a OR site:b)"
    assert search.parse_query("x -site:A site:b y") == {"terms": ["x", "y"], "must": ["b"], "must_not": ["a"]}


def test_options() -> None:
    o = from_headers({"X-Respond-With": "markdown", "x-timeout": "500s", "x-target-selector": "a, b", "x-no-cache": "false", "x-md-link-style": "discarded", "x-retain-images": "nonsense"})
    assert (o.respond_with, o.timeout, o.target_selector, o.no_cache, o.retain_images) == ("markdown", 180, ("a", "b"), False, "all")
    assert o.markdown == {"link_style": "discarded"} and o.wait_for_selector == ("a", "b")
    assert ReadOptions.preset("index").not_default()["retain_links"] == "text"
    for bad in ({"respond_with": "vlm+markdown"}, {"timeout": 0}, {"target_selector": ("*",)}, {"max_tokens": 1}, {"retain_links": "x"}):
        with pytest.raises(OptionError):
            ReadOptions(**bad)


def test_formatted(spark) -> None:  # noqa: ANN001
    rows = [(1, "https://h/p", None, "<title>T</title><h1>H</h1><p>one <a href='/l'>link</a></p><p>two</p>", 404, "Not Found", False, False), (2, "https://h/q", None, None, 200, "OK", False, False), (3, None, None, "", 200, "OK", True, True)]
    df = spark.createDataFrame(rows, "page_id long, url string, href string, html string, status int, status_text string, is_intermediate boolean, is_from_cache boolean")
    got = {r["page_id"]: r for r in formatted(df, ReadOptions.preset("spider", token_budget=2)).collect()}
    assert "[link](https://h/l)" in got[1]["markdown"] and got[1]["budget_error"] == "BudgetExceeded" and "404" in got[1]["warning"] and got[1]["chunks"]
    assert got[2]["markdown"] is None and got[3]["error"] is None


def test_documents(spark) -> None:  # noqa: ANN001
    assert csv_markdown("a,b\n1,2\n") == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert parse_feed("<rss><channel><item><title>t</title><link>u</link></item></channel></rss>")[1][0]["link"] == "u"
    assert parse_feed('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>t</title><link href="u"/></entry></feed>')[1][0]["link"] == "u"
    assert parse_feed("<urlset><url><loc>u</loc></url></urlset>") == ("urlset", [{"title": "", "description": "", "link": "u", "date": ""}])
    assert decode_html("<meta charset=windows-1252>é".encode("cp1252")).endswith("é")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p></w:body></w:document>')
    assert document_markdown("a.docx", buffer.getvalue()) == ("# Head\n\ntext", None)
    assert document_markdown("a.docx", b"broken")[0] is None
    assert document_markdown("a.doc", b"x")[1] == "doc is not supported"
    assert pdf_pages(b"<< /Length 9 >>\nstream\nBT /F1 24 Tf (Hi \\(x\\)) Tj ET\nendstream")[0] == [{"text": "Hi (x)", "height": 24.0}]


def test_stateful_stream(spark, tmp_path) -> None:  # noqa: ANN001
    rows = [("k", 0, 100), ("k", 100, 101), ("k", 200, 120), ("k", 1500, 120)]
    spark.createDataFrame(rows, "key string, at_ms long, elements long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, at_ms long, elements long").parquet(str(tmp_path / "in"))
    query = observations.throttled_reports(stream, None).writeStream.format("memory").queryName("reports").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["at_ms"] for r in spark.sql("select * from reports").collect()) == [0, 200, 1500]


def test_stateful_table(spark) -> None:  # noqa: ANN001
    rows = [("k", 0, "a"), ("k", 50, "b"), ("k", 90, "c"), ("k", 130, "d"), ("k", 500, "e"), ("m", 5, "x"), ("m", 6, "y"), (None, 1, "z")]
    df = spark.createDataFrame(rows, "key string, at_ms long, value string")
    got = sorted(tuple(r) for r in observations.conflated_writes(df, 100).collect())
    assert got == [("k", 0, "a"), ("k", 100, "c"), ("k", 200, "d"), ("k", 500, "e"), ("m", 5, "x"), ("m", 105, "y")]
    texts = observations.incremental_text(df.selectExpr("key as stream_id", "at_ms as seq", "value as chunk"))
    assert {(r["stream_id"], r["seq"]): r["text"] for r in texts.collect()}[("k", 130)] == "abcd"
    assert observations.conflated_writes(df.limit(0), 100).count() == 0


def test_text_stream(spark, tmp_path) -> None:  # noqa: ANN001
    spark.createDataFrame([("s", 1, "ab"), ("s", 2, "c"), ("t", 1, None)], "stream_id string, seq long, chunk string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream_id string, seq long, chunk string").parquet(str(tmp_path / "in"))
    query = observations.incremental_text(stream, None).writeStream.format("memory").queryName("texts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.sql("select * from texts").collect()) == [("s", 1, "ab"), ("s", 2, "abc"), ("t", 1, "")]


def test_chain(spark) -> None:  # noqa: ANN001
    points = spark.createDataFrame([(1, 5), (2, 1 << 22), (3, None), (4, 99)], "id long, number long")
    ranges = spark.createDataFrame([(0, 50, 7), (3, 9, 8), (1 << 21, 1 << 23, 9)], "first long, last long, asn long")
    assert {r["id"]: r["asn"] for r in chain.range_lookup(points, ranges, "id").collect()} == {1: 8, 2: 9, 3: None, 4: None}
    assert chain.range_lookup(points.limit(0), ranges, "id").count() == 0
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(chain.is_temporal(F.lit("https://h/a.pdf?sig=1"))) and not one(chain.is_temporal(F.lit("https://h/a.pdf#p?")))


def test_json_events(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(1, '{"a": [1, "x"], "b": {}}'), (2, None), (3, "no json"), (4, '{"a": [1, "y')], "id long, body string")
    got: dict = {}
    for r in prompts.json_events(spark, df, "body", "id").collect():
        got.setdefault(r["id"], []).append((r["path"], r["kind"], r["value"]))
    assert got[1] == [("$", "object", None), ("$.a", "array", None), ("$.a.0", "value", "1"), ("$.a.1", "value", '"x"'), ("$.a", "end", None), ("$.b", "object", None), ("$.b", "end", None), ("$", "end", None)]
    assert got[4][:3] == [("$", "object", None), ("$.a", "array", None), ("$.a.0", "value", "1")] and 2 not in got


def test_queries_match_sql(spark, data) -> None:  # noqa: ANN001
    duckdb = pytest.importorskip("duckdb")
    import glob
    import os

    from pagewright.plans import catalog

    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name, sql in catalog.ORACLE.items():
        df = catalog.QUERIES[name](spark, data)
        names = sorted(df.columns)
        mine = sorted(str(tuple(r[c] for c in names)) for r in df.collect())
        theirs = con.sql(f"select {', '.join(names)} from ({sql})").fetchall()
        assert mine == sorted(str(tuple(r)) for r in theirs), name
