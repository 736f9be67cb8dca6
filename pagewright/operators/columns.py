"""Queries of the column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import markup, urls
from pagewright.functions.text import site_of
from pagewright.operators.pages import estimated_tokens
from pagewright.operators.results import batch_answer
from pagewright.storage import bounded_broadcast, table


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "formatted_pages").select("page_id", urls.url_digest(F.col("url")).alias("digest"), site_of(F.col("url")).alias("site")).distinct()


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "serp_entries").select("entry_id", urls.registrable_domain(site_of(F.col("link"))).alias("domain")).distinct()


def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO 639-3 codes of labels, by the exact key, then by the all-lower-case one, else `und`."""
    codes = bounded_broadcast(table(spark, sf_dir, "languages").select("bcp47", "iso639_3"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    low = codes.select(F.lower("bcp47").alias("low"), F.col("iso639_3").alias("by_low")).dropDuplicates(["low"])
    found = docs.join(codes, F.col("lang") == F.col("bcp47"), "left").join(bounded_broadcast(low), F.lower("lang") == F.col("low"), "left")
    return found.select("doc_id", F.coalesce("iso639_3", "by_low", F.lit("und")).alias("iso639_3"))


def front_matters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter of every page, with its lists of images and links."""
    p = table(spark, sf_dir, "formatted_pages").dropDuplicates(["page_id"])
    text = markup.front_matter(F.col("title"), F.col("description"), F.col("url"), F.col("published_time"), F.col("warning"), F.col("content"), F.col("images"), F.col("links"))
    return p.select("page_id", F.md5(text).alias("frontmatter_md5"))


def plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain representation of every page, with its warning and lists of images and links."""
    p = table(spark, sf_dir, "formatted_pages").dropDuplicates(["page_id"])
    text = markup.plain_representation(F.col("title"), F.col("url"), F.col("published_time"), F.col("warning"), F.col("num_pages"), F.col("content"), F.col("images"), F.col("links"))
    return p.select("page_id", F.md5(text).alias("plain_md5"))


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "snapshots").select("page_id", markup.status_warning(F.col("status"), F.col("status_text")).alias("warning")).distinct()


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "formatted_pages").select("page_id", "tokens", F.length("description").alias("d")).distinct()
    return p.select("page_id", markup.token_charge(F.col("tokens"), F.col("d"), F.lit(0), F.lit(0), F.lit(1)).alias("charge"))


def pseudo_bools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "serp_entries").select("entry_id", markup.pseudo_bool(F.col("variant"), strict=False).alias("loose"), markup.pseudo_bool_or_null(F.col("variant")).alias("strict")).distinct()


def nonpublic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made of ids, so that every range comes up."""
    ip = F.concat_ws(".", F.pmod("c_custkey", F.lit(256)), F.pmod(F.col("c_custkey") * 7, F.lit(256)), F.pmod(F.col("c_custkey") * 13, F.lit(256)), F.lit("9"))
    return table(spark, sf_dir, "customer").select("c_custkey", urls.non_public_ipv4(ip).alias("non_public"), urls.ipv4_in_cidr(ip, F.lit("100.64.0.0/10")).alias("in_cidr"))


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", estimated_tokens(F.col("text")).cast("long").alias("tokens"))


def squeezed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "formatted_pages").select("page_id", "content").filter("content is not null").distinct()
    return p.select("page_id", F.md5(markup.tidy_markdown(F.col("content"))).alias("tidy_md5"), F.md5(markup.squeeze_lines(F.col("content"))).alias("squeezed_md5"))


def batch_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result rows of every query as one batch: each answer in order, with its error where there is no snippet."""
    rows = table(spark, sf_dir, "serp_entries").dropDuplicates(["entry_id"])
    order = F.row_number().over(Window.partitionBy("query_digest").orderBy("provider_ord", "rank", "entry_id")) - 1
    error = F.when(F.col("snippet").isNull(), F.concat(F.lit("no text from "), F.col("provider")))
    pages = rows.select(F.col("query_digest").alias("batch"), order.alias("ord"), F.col("link").alias("url"), F.col("snippet").alias("content"), error.alias("error"))
    return batch_answer(pages).select("batch", F.length("answer").alias("n_chars"), F.md5("answer").alias("answer_md5"))


def link_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of formatted pages, the first of each address."""
    p = table(spark, sf_dir, "formatted_pages").select("page_id", "links").distinct()
    rows = p.select("page_id", F.posexplode("links").alias("ord", "l")).select("page_id", "ord", "l.text", "l.href").filter("href not rlike '^(file|javascript):'")
    return rows.groupBy("page_id", "href").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    "url_digest": digests, "registrable_domain": domains, "bcp47_iso": language_codes, "frontmatter": front_matters, "plain_representation": plain_texts, "status_warning": statuses, "charge_amount": charges, "pseudo_bool": pseudo_bools,
    "ip_nonpublic": nonpublic, "token_estimate": token_estimates, "tidy_markdown": squeezed, "batch_text": batch_text, "links_unique_by_href": link_lists,
}
_SITE = r"nullif(regexp_replace(regexp_extract(lower(%s), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', ''), '')"
_URL = _SITE.replace("%s", "url")
_FALSE = "('', 'false', 'none', 'null', 'nan', 'nil', '0', 'no', 'undefined', 'disabled', 'f', 'n/a')"
_ONE = "with p as (select page_id, any_value(title) as title, any_value(description) as description, any_value(url) as url, any_value(published_time) as published_time, any_value(warning) as warning, any_value(num_pages) as num_pages, any_value(content) as content, any_value(images) as images, any_value(links) as links from formatted_pages group by page_id)"


def _LISTS(images: str, links: str) -> str:  # noqa: N802
    """SQL of the lists of images and links under their headings."""
    return f"""concat_ws(chr(10) || chr(10),
  case when images is not null then '{images}' || chr(10) || case when cardinality(images) > 0 then array_to_string(list_transform(map_entries(images), lambda e: '- ![' || e.key || '](' || coalesce(e.value, '') || ')'), chr(10)) else '{markup.NO_IMAGES}' end end,
  case when links is not null then '{links}' || chr(10) || case when len(links) > 0 then array_to_string(list_transform(links, lambda l: '- [' || coalesce(l.text, '') || '](' || coalesce(l.href, '') || ')'), chr(10)) else '{markup.NO_LINKS}' end end)"""


ORACLE = {
    "url_digest": f"select distinct page_id, md5(lower(case when url like '%#/%' then url else regexp_replace(url, '#.*$', '') end)) as digest, {_URL} as site from formatted_pages",
    "registrable_domain": f"with s as (select distinct entry_id, string_split({_SITE.replace('%s', 'link')}, '.') as l from serp_entries) select entry_id, case when len(l) > 2 and length(l[-1]) = 2 and l[-2] in ('co', 'com', 'org', 'net', 'gov', 'edu', 'ac', 'or', 'ne', 'go', 'gob', 'govt') then array_to_string(l[-3:], '.') else array_to_string(l[-2:], '.') end as domain from s",
    "bcp47_iso": "select doc_id, coalesce(e.iso639_3, l.iso639_3, 'und') as iso639_3 from documents left join languages e on lang = e.bcp47 left join languages l on lower(lang) = lower(l.bcp47)",
    "status_warning": "select distinct page_id, case when status < 200 or status >= 400 then 'Target URL returned error ' || status || ': ' || coalesce(status_text, '') end as warning from snapshots",
    "charge_amount": "select page_id, least(2000000, coalesce(tokens, d, 0) + 765) as charge from (select distinct page_id, tokens, length(description) as d from formatted_pages)",
    "pseudo_bool": f"select distinct entry_id, not (variant is null or lower(trim(variant)) in {_FALSE}) as loose, case when variant is null or lower(trim(variant)) in {_FALSE} then false when lower(trim(variant)) in ('true', 'yes', '1', 'ok', 'enabled', 't') then true end as strict from serp_entries",
    "ip_nonpublic": """with n as (select c_custkey, c_custkey % 256 as a, c_custkey * 7 % 256 as b from customer)
select c_custkey, (a in (0, 10, 127) or a >= 224 or (a = 100 and b between 64 and 127) or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and b = 168)) as non_public, (a = 100 and b between 64 and 127) as in_cidr from n""",
    "token_estimate": r"select doc_id, len(regexp_extract_all(text, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{M}]+|\p{Nd}{1,3}|[^\s\p{L}\p{M}\p{Nd}]')) as tokens from documents",
    "batch_text": """with r as (select query_digest, provider, link, snippet, row_number() over (partition by query_digest order by provider_ord, rank, entry_id) as n from (select distinct on (entry_id) * from serp_entries)),
t as (select query_digest as batch, string_agg('### ' || link || ' (' || n || ')' || chr(10) || chr(10) || coalesce(snippet, '> Error: no text from ' || provider), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by n) as answer from r group by 1)
select batch, cast(length(answer) as integer) as n_chars, md5(answer) as answer_md5 from t""",
    "tidy_markdown": r"""with p as (select distinct page_id, content from formatted_pages where content is not null),
t as (select page_id, content, regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\[\s*\n+\s*([^\[\]\n]+?)\s*\n+\s*\]\(', '[\1](', 'g'), '\]\s*\n+\s*\((https?://)', '](\1', 'g'), '\]\(\s*([^\s()]+)\s*\)', '](\1)', 'g'), '\n{3,}', chr(10) || chr(10), 'g') as a,
  string_split(content, chr(10)) as lines from p)
select page_id, md5(trim(regexp_replace(a, '(?m)^[ \t]+', '', 'g'))) as tidy_md5, md5(array_to_string(list_filter(lines, lambda x, i: trim(x) <> '' or (i > 1 and trim(lines[i - 1]) <> '')), chr(10))) as squeezed_md5 from t""",
    "plain_representation": _ONE + """, m as (select *, concat_ws(chr(10) || chr(10), case when coalesce(published_time, '') <> '' then 'Published Time: ' || published_time end,
  case when coalesce(warning, '') <> '' then 'Warning: ' || replace(warning, chr(10), chr(10) || 'Warning: ') end, case when num_pages <> 0 then 'Number of Pages: ' || num_pages end) as mixed from p)
select page_id, md5('Title: ' || coalesce(title, '') || chr(10) || chr(10) || 'URL Source: ' || coalesce(url, '') || chr(10) || case when mixed <> '' then chr(10) || mixed || chr(10) else '' end
  || chr(10) || 'Markdown Content:' || chr(10) || coalesce(content, '') || chr(10) || case when """ + _LISTS("Images:", "Links/Buttons:") + """ <> '' then chr(10) || """ + _LISTS("Images:", "Links/Buttons:") + """ || chr(10) else '' end) as plain_md5 from m""",
    "frontmatter": _ONE + """ select page_id, md5(concat_ws(chr(10), '---', case when coalesce(title, '') <> '' then 'title: ' || to_json(title) end, case when coalesce(description, '') <> '' then 'description: ' || to_json(description) end,
  case when coalesce(url, '') <> '' then 'url: ' || to_json(url) end, case when coalesce(published_time, '') <> '' then 'publishedTime: ' || to_json(published_time) end, case when coalesce(warning, '') <> '' then 'warning: ' || to_json(warning) end, '---')
  || chr(10) || chr(10) || coalesce(content, '') || case when """ + _LISTS("## Images", "## Links/Buttons") + """ <> '' then chr(10) || chr(10) || """ + _LISTS("## Images", "## Links/Buttons") + """ || chr(10) else '' end) as frontmatter_md5 from p""",
    "links_unique_by_href": "with p as (select distinct page_id, links from formatted_pages), r as (select page_id, unnest(range(0, len(links))) as ord, unnest(links) as l from p) select page_id, l.href as href, cast(min(ord) as integer) as first_ord, count(*) as n from r where not regexp_matches(l.href, '^(file|javascript):') group by 1, 2",
}
