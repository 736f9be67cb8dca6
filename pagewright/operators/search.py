"""Search algebra on result tables: query grammar, relevance, first non-empty provider, de-duplication, top-k, relaxation, charges."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions.text import site_of
from pagewright.functions.urls import url_digest
from pagewright.storage import staged, table

#: Operators of the query grammar.
KEYS = ("ext", "filetype", "intitle", "loc", "site")


def normalised_query(query: Column) -> Column:
    return F.trim(F.regexp_replace(query, r"(?U)\s+", " "))


def with_operators(query: str, **values: list[str] | str) -> str:
    """A query with explicit operators: values of a key joined by OR, keys by AND."""
    groups = []
    for key in KEYS:
        given = values.get(key) or []
        given = [given] if isinstance(given, str) else list(given)
        if given:
            groups.append(" OR ".join(f"{key}:{v}" for v in given))
    if not groups:
        return query
    tail = groups[0] if len(groups) == 1 else " AND ".join(f"({g})" if " OR " in g else g for g in groups)
    return f"{query} {tail}".strip()


def parse_query(query: str) -> dict[str, list[str]]:
    """Terms and the sites that results must, and must not, be on."""
    words = query.split()
    must = [w[5:].lower() for w in words if w.lower().startswith("site:") and len(w) > 5]
    must_not = [w[6:].lower() for w in words if w.lower().startswith("-site:") and len(w) > 6]
    return {"terms": [w for w in words if not re.match(r"(?i)-?site:", w)], "must": must, "must_not": must_not}


def site_filter(results: DataFrame, query: str, link: str = "link") -> DataFrame:
    """Results on the wanted sites: a registered name matches all hosts below it."""
    parsed, site = parse_query(query), site_of(F.col(link))
    on = lambda s: (site == s) | site.endswith(f".{s}")
    for s in parsed["must_not"]:
        results = results.filter(~F.coalesce(on(s), F.lit(False)))
    if parsed["must"]:
        any_ = F.lit(False)
        for s in parsed["must"]:
            any_ = any_ | on(s)
        results = results.filter(any_)
    return results


def relevant(query: Column, title: Column, snippet: Column, link: Column) -> Column:
    """Whether a result has the whole query, any term of two characters or more, or any pair of an ideographic run."""
    plain = F.lower(normalised_query(F.regexp_replace(query, r"(?i)-?\b(?:site|ext|filetype|intitle|loc):\S+|[\"()]|\b(?:OR|AND)\b", " ")))
    bare = F.regexp_replace(F.regexp_replace(link, r"[?#].*$", ""), r"^[a-z]+://", "")
    text = F.lower(F.concat_ws(" ", title, snippet, bare))
    terms = F.filter(F.split(plain, r"[\s,._\-]+"), lambda t: F.length(t) >= 2)
    pairs = F.flatten(F.transform(F.regexp_extract_all(plain, F.lit(r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{2,})"), F.lit(1)), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return (plain == "") | text.contains(plain) | F.exists(F.concat(terms, pairs), lambda t: text.contains(t))


def first_provider(results: DataFrame, query: str = "query_digest", order: str = "provider_ord") -> DataFrame:
    """Rows of each query's first provider that has any."""
    first = results.groupBy(query).agg(F.min(order).alias("_first"))
    return results.join(first, query).filter(F.col(order) == F.col("_first")).drop("_first")


def unique_links(results: DataFrame, query: str = "query_digest", order: tuple[str, ...] = ("provider_ord", "rank", "entry_id")) -> DataFrame:
    """The first row of each link of a query."""
    w = Window.partitionBy(query, url_digest(F.col("link"))).orderBy(*order)
    return results.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_k(results: DataFrame, k: int, qualified: Column, query: str = "query_digest", order: tuple[str, ...] = ("provider_ord", "rank", "entry_id")) -> DataFrame:
    """k rows of each query in the old order, rows that don't qualify only where others are too few.

    Spark's limit within a window keeps k rows of each group and partition before the shuffle.
    """
    w = Window.partitionBy(query).orderBy(F.when(qualified, 0).otherwise(1), *order)
    return results.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


# Letters of scripts that are written from right to left.
RIGHT_TO_LEFT = "[\u0590-\u05ff\u0600-\u06ff\u0700-\u074f\u0750-\u077f\u0780-\u07bf\u07c0-\u07ff\u08a0-\u08ff\ufb1d-\ufb4f\ufb50-\ufdff\ufe70-\ufeff]"


def relaxed_queries(query: Column, tries: int = 3) -> Column:
    """Candidates in turn: the query, then without one, two and three quarters of its terms, from the end, or from the beginning in scripts
    written from right to left; at last two terms."""
    terms = F.split(F.trim(query), r"\s+")
    back = query.rlike(RIGHT_TO_LEFT)
    n = F.size(terms)
    quarter = F.ceil(n / 4).cast("int")
    left = [F.greatest(n - quarter * k, F.lit(0)) for k in range(1, tries + 1)]
    take = lambda k: F.array_join(F.when(back, F.slice(terms, n - k + 1, k)).otherwise(F.slice(terms, 1, k)), " ")
    last = F.least(n, F.lit(2))
    return F.filter(F.array_distinct(F.array(F.array_join(terms, " "), *(F.when(k > 0, take(k)) for k in left), take(last))), lambda q: q.isNotNull() & (q != ""))


def search_charge(results: DataFrame, tokens: str, per_ten: int = 10_000, scaler: float = 1.0, cap: int = 2_000_000, query: str = "query_digest") -> DataFrame:
    """Charge of each query: tokens of its contents, at least a price for each ten results, at most the cap."""
    by = results.groupBy(query).agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("_t"), F.count(F.lit(1)).alias("_n"))
    return by.select(query, F.least(F.lit(cap).cast("double"), F.greatest(F.col("_t").cast("double"), F.ceil(F.col("_n") / 10) * per_ten * scaler)).cast("long").alias("charge"))


def local_index(docs: DataFrame, query: str, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The best `k` (doc_id, score) of `docs` (doc_id, text) by BM25: only the query's words are counted, in one pass over the texts."""
    terms = sorted({t for t in re.split(r"\W+", query.lower()) if t})
    lowered = F.lower(F.coalesce(F.col("text"), F.lit("")))
    counted = staged(docs.select("doc_id", F.size(F.split(lowered, r"[^\p{L}\p{Nd}]+")).alias("n"), *(F.regexp_count(lowered, F.lit(rf"(?<![\p{{L}}\p{{Nd}}]){re.escape(t)}(?![\p{{L}}\p{{Nd}}])")).alias(f"t{i}") for i, t in enumerate(terms))), "counted")
    stats = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *(F.sum((F.col(f"t{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms)))).first()  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"t{i}"), stats[f"df{i}"] or 0
        score = score + math.log(1 + (stats["docs"] - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.lit(stats["mean"] or 1.0)))
    return counted.select("doc_id", F.round(score, 6).alias("score")).filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)


_SERP = ("entry_id", "query_digest", "provider", "provider_ord", "rank", "link", "title", "source", "date", "snippet", "variant")


def _serp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "serp_entries").select(*_SERP).distinct()


def search_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _serp(spark, sf_dir).filter(relevant(F.lit("garden station library"), F.col("title"), F.col("snippet"), F.col("link"))).select("entry_id")


def search_provider_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_provider(_serp(spark, sf_dir)).select("entry_id", "query_digest", "provider_ord")


def search_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique_links(_serp(spark, sf_dir)).select("entry_id", "query_digest")


def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(unique_links(_serp(spark, sf_dir)), 5, F.col("snippet").isNotNull()).select("entry_id", "query_digest")


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results joined to the formatted pages of their links, for the charge."""
    pages = table(spark, sf_dir, "formatted_pages").select(F.col("url").alias("p_url"), "page_id", "tokens").distinct()
    pages = pages.groupBy(url_digest(F.col("p_url")).alias("d")).agg(F.max("tokens").alias("tokens"))
    return search_charge(unique_links(_serp(spark, sf_dir)).join(pages, url_digest(F.col("link")) == F.col("d"), "left"), "tokens")


def search_site_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_filter(_serp(spark, sf_dir), "anything -site:ildzim-journal.test -site:kelkel-post.test").select("entry_id")


def search_local_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local_index(table(spark, sf_dir, "documents").select("doc_id", "text"), "markdown library station", 20)


def query_relaxation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of every title among the results, taken as a query."""
    titles = table(spark, sf_dir, "serp_entries").filter("trim(title) <> ''").select("entry_id", "title").distinct()
    return titles.select("entry_id", F.posexplode(relaxed_queries(F.col("title"))).alias("attempt", "candidate"))


QUERIES = {
    "search_relevance": search_relevance, "search_provider_argmin": search_provider_argmin, "search_dedupe": search_dedupe, "search_topk": search_topk, "search_charge": search_results, "site_filter": search_site_filter,
    "local_index": search_local_index, "query_relaxation": query_relaxation,
}
_DIGEST = "md5(lower(case when link like '%#/%' then link else regexp_replace(link, '#.*$', '') end))"
_ROWS = "serp as (select distinct entry_id, query_digest, provider, provider_ord, rank, link, title, source, date, snippet, variant from serp_entries)"
_UNIQUE = f"uniq as (select * from serp qualify row_number() over (partition by query_digest, {_DIGEST} order by provider_ord, rank, entry_id) = 1)"
_SITE = r"regexp_replace(regexp_extract(lower(link), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', '')"
ORACLE = {
    "local_index": r"""with w as (select doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{Nd}]+') as words from documents),
c as (select doc_id, len(words) as n, unnest(['library', 'markdown', 'station']) as term, words from w), f as (select doc_id, n, term, len(list_filter(words, lambda x: x = term)) as tf from c),
s as (select count(*) as docs, avg(len(words)) as mean from w), d as (select term, count(*) filter (where tf > 0) as df from f group by term)
select doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) as score from f join d using (term), s group by doc_id having score > 0 order by score desc, doc_id limit 20""",
    "query_relaxation": rf"""with t as (select distinct entry_id, title, regexp_split_to_array(trim(title), '\s+') as w, regexp_matches(title, '{RIGHT_TO_LEFT}') as back from serp_entries where trim(title) <> ''),
k as (select *, len(w) as n, cast(ceil(len(w) / 4.0) as bigint) as q from t),
c as (select entry_id, unnest([n, greatest(n - q, 0), greatest(n - 2 * q, 0), greatest(n - 3 * q, 0), least(n, 2)]) as m, unnest([0, 1, 2, 3, 4]) as i, w, n, back from k),
d as (select entry_id, min(i) as i, array_to_string(case when back then w[n - m + 1 : n] else w[1 : m] end, ' ') as candidate from c where m > 0 group by entry_id, candidate)
select entry_id, cast(row_number() over (partition by entry_id order by i) - 1 as integer) as attempt, candidate from d""",
    "search_relevance": rf"""with {_ROWS}, t as (select entry_id, lower(concat_ws(' ', title, snippet, regexp_replace(regexp_replace(link, '[?#].*$', ''), '^[a-z]+://', ''))) as t from serp)
select entry_id from t where contains(t, 'garden') or contains(t, 'station') or contains(t, 'library')""",
    "search_provider_argmin": f"with {_ROWS} select entry_id, query_digest, provider_ord from serp qualify provider_ord = min(provider_ord) over (partition by query_digest)",
    "search_dedupe": f"with {_ROWS}, {_UNIQUE} select entry_id, query_digest from uniq",
    "search_topk": f"with {_ROWS}, {_UNIQUE} select entry_id, query_digest from uniq qualify row_number() over (partition by query_digest order by case when snippet is not null then 0 else 1 end, provider_ord, rank, entry_id) <= 5",
    "search_charge": f"""with {_ROWS}, {_UNIQUE}, pages as (select {_DIGEST.replace('link', 'url')} as d, max(tokens) as tokens from formatted_pages group by 1)
select query_digest, cast(least(2000000, greatest(coalesce(sum(tokens), 0), ceil(count(*) / 10.0) * 10000)) as bigint) as charge from (select uniq.query_digest, pages.tokens from uniq left join pages on {_DIGEST} = d) group by query_digest""",
    "site_filter": f"with {_ROWS} select entry_id from serp where not ({_SITE} = 'ildzim-journal.test' or {_SITE} like '%.ildzim-journal.test' or {_SITE} = 'kelkel-post.test' or {_SITE} like '%.kelkel-post.test')",
}
