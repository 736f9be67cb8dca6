"""Cache and policy algebra: freshness, as-of lookups, stale fallbacks, gates, blockades, robots rules, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions.text import site_of
from pagewright.functions.urls import url_digest
from pagewright.operators.pages import TOKEN_SQL, estimated_tokens
from pagewright.storage import table

# Tolerances and lifetimes in seconds.
FRESH, SEARCH_FRESH = 3600, 86400
LIFETIME = {"page": 7 * 86400, "url": 4 * 3600, "domain_profile": 30 * 86400, "abuse": 3600}
MOST_ERRORS, ERROR_WINDOW = 10, 3600
MOST_REQUESTS, MOST_DOCUMENTS, MOST_DOMAINS = 3300, 1000, 200
# Error names with their codes and HTTP statuses.
ERRORS = {
    "AuthenticationRequired": (40103, 401), "AuthenticationFailed": (40101, 401), "InsufficientBalance": (40203, 402), "OperationNotAllowed": (40301, 403), "SecurityCompromise": (45103, 451), "ParamValidation": (40001, 400),
    "AssertionFailure": (42206, 422), "BudgetExceeded": (40904, 409), "RateLimitTriggered": (42903, 429), "ServiceCrashed": (50302, 503), "ServiceNodeResourceDrain": (50302, 503), "Internal": (50001, 500),
}


def is_fresh(created_at: Column, now: Column, coerced: Column, tolerance: int = FRESH) -> Column:
    """A row made to hold, or one not older than the tolerance."""
    return F.coalesce(coerced, F.lit(False)) | (F.unix_micros(created_at.cast("timestamp")) >= F.unix_micros(now.cast("timestamp")) - tolerance * 1_000_000)


def latest(cache: DataFrame, key: str = "digest", at: str = "created_at", *order: str) -> DataFrame:
    """The newest row of each key; a struct maximum keeps one row for each key and partition before the shuffle."""
    rest = [c for c in cache.columns if c != key]
    first = [at, *order, *(c for c in rest if c not in (at, *order) and not dict(cache.dtypes)[c].startswith("map"))]
    return cache.groupBy(key).agg(F.max(F.struct(*first)).alias("_m")).select(key, *(F.col("_m")[c].alias(c) for c in first)).select(*(c for c in cache.columns if c == key or c in first))


def cache_asof(requests: DataFrame, cache: DataFrame, tolerance: int = FRESH, locale: bool = False) -> DataFrame:
    """Each request (request_id, digest, at, and locale) with the newest cache row that isn't younger; hit says whether it holds.

    locale: the row's locale must be equal, null like null.
    """
    c = cache.select(F.col("digest").alias("c_digest"), F.col("created_at").alias("c_created"), F.col("coerced").alias("c_coerced"), F.col("locale").alias("c_locale"))
    on = (F.col("digest") == F.col("c_digest")) & (F.col("c_created") <= F.col("at"))
    if locale:
        on = on & F.col("locale").eqNullSafe(F.col("c_locale"))
    joined = requests.join(c, on, "left")
    best = joined.groupBy("request_id").agg(F.max(F.struct("c_created", "c_coerced", "at")).alias("m"))
    hit = F.coalesce(is_fresh(F.col("m")["c_created"], F.col("m")["at"], F.col("m")["c_coerced"], tolerance), F.lit(False))
    return best.select("request_id", F.col("m")["c_created"].alias("cached_at"), hit.alias("hit"))


def with_fallback(fresh: Column, fetched: Column, stale: Column, backup: Column) -> Column:
    return F.coalesce(fresh, fetched, stale, backup)


def error_gate(errors: DataFrame, most: int = MOST_ERRORS, window: int = ERROR_WINDOW) -> DataFrame:
    """Keys with more than `most` errors since their last success within the window before their last event.

    errors: (key, at, ok).
    """
    marks = errors.groupBy("key").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("_ok"), F.max("at").alias("_now"))
    late = errors.join(marks, "key").filter(~F.col("ok") & (F.col("_ok").isNull() | (F.col("at") > F.col("_ok"))) & (F.unix_micros("at") >= F.unix_micros("_now") - window * 1_000_000))
    return late.groupBy("key").agg(F.count(F.lit(1)).alias("n_errors")).filter(F.col("n_errors") > most)


def not_blocked(pages: DataFrame, blockades: DataFrame, now: Column, url: str = "url") -> DataFrame:
    """Pages whose host isn't blocked at `now`: an anti join on host with a predicate on the expiry."""
    b = blockades.filter(F.col("expire_at") > now).select(F.col("domain").alias("_domain"))
    return pages.join(b, site_of(F.col(url)) == F.col("_domain"), "left_anti")


def robots_verdict(requests: DataFrame, robots: DataFrame) -> DataFrame:
    """(request_id, allowed): robots rules scanned in order, the first that matches wins.

    requests: (request_id, origin, path, agent). robots: (origin, body). Rules hold before any agent line, and below one that names `*` or the
    agent's exact lower-case name. An empty rule, a missing body and a path without rule allow. Rules are compared with the path and a closing
    `?`; a Disallow with `*` with the bare path's head and tail. Nothing but lines that begin with `#` is a comment.
    """
    lines = robots.select("origin", F.posexplode(F.split("body", "\r?\n")).alias("line_no", "raw"))
    lines = lines.withColumn("raw", F.trim("raw")).filter("raw <> '' and raw not like '#%'")
    lines = lines.select("origin", "line_no", F.lower(F.trim(F.substring_index("raw", ":", 1))).alias("name"), F.trim(F.regexp_extract("raw", "^[^:]*:(.*)$", 1)).alias("value"))
    order = Window.partitionBy("origin").orderBy("line_no")
    rules = lines.withColumn("agent_rule", F.last(F.when(F.col("name") == "user-agent", F.lower("value")), ignorenulls=True).over(order)).filter("name in ('allow', 'disallow')")
    rules = rules.select(F.col("origin").alias("r_origin"), "line_no", "name", "value", "agent_rule")
    joined = requests.join(rules, (F.col("origin") == F.col("r_origin")) & (F.col("agent_rule").isNull() | (F.col("agent_rule") == F.lower("agent")) | (F.col("agent_rule") == "*")), "left")
    parts = F.split("value", r"\*")
    starred = F.col("path").startswith(parts[0]) & F.col("path").endswith(F.get(parts, F.lit(1)))
    match = F.when(F.col("value") == "", True).when((F.col("name") == "disallow") & F.col("value").contains("*"), starred).otherwise(F.concat("path", F.lit("?")).startswith(F.col("value")))
    verdict = (F.col("value") == "") | (F.col("name") == "allow")
    first = joined.groupBy("request_id").agg(F.min_by(F.when(match, verdict), F.when(match, F.col("line_no"))).alias("v"))
    return first.select("request_id", F.coalesce("v", F.lit(True)).alias("allowed"))


def index_eligible(title: Column, intermediate: Column, status: Column, tokens: Column, elements: Column, traits: Column, html: Column) -> Column:
    """Whether a snapshot is worth indexing: titled, final if a browser made it, and, where no trait tells its kind, of 200 tokens or a
    good status without a challenge."""
    challenge = html.contains("captcha") | html.contains("cf-turnstile")
    full = (F.coalesce(tokens, F.lit(0)) >= 200) | (status.eqNullSafe(200) & ~F.coalesce(challenge, F.lit(False)))
    made = (F.coalesce(elements, F.lit(0)) > 0) & F.coalesce(intermediate, F.lit(False))
    return (F.trim(F.coalesce(title, F.lit(""))) != "") & ~made & ((F.coalesce(F.size(traits), F.lit(0)) > 0) | full)


def next_action(status: Column, tokens: Column) -> Column:
    """What follows a fetch: keep it, or fetch again through another way."""
    return F.when(status.isin(201, 202, 404, 405), "keep").when((tokens < 42) | (status != 200), "retry").otherwise("keep")


def abusive(requests: DataFrame) -> DataFrame:
    """Pages with too many requests, documents or registered domains. requests: (page_id, kind, domain)."""
    by = requests.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "document").alias("n_documents"), F.count_distinct("domain").alias("n_domains"))
    return by.filter((F.col("n") > MOST_REQUESTS) | (F.col("n_documents") > MOST_DOCUMENTS) | (F.col("n_domains") > MOST_DOMAINS))


# Alternative texts that say nothing.
GENERIC_ALTS = ["image", "img", "photo", "picture", "pic", "alt", "figure", "fig", "图片"]


def image_alt_decision(alt: Column, generated: Column, width: Column, height: Column) -> Column:
    """Alternative text: the page's unless it is a generic word, texts for trackers and small images, else the generated one."""
    size = F.concat(F.lit("A "), width.cast("string"), F.lit("x"), height.cast("string"))
    least = F.least(width, height)
    small = F.when(least <= 1, F.concat(size, F.lit(" image, likely be a tacker probe"))).when(least < 64, F.concat(size, F.lit(" small image, likely a logo, icon or avatar")))
    return F.when((F.trim(F.coalesce(alt, F.lit(""))) != "") & ~F.lower(F.trim(alt)).isin(*GENERIC_ALTS), alt).when(small.isNotNull(), small).otherwise(F.coalesce(generated, F.lit("")))


# Queries over the page cache, snapshots and events.


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_cache").select("digest", "coerced", "locale", "created_at", "expire_at").distinct()


def cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(_cache(spark, sf_dir), "digest", "created_at", "expire_at").select("digest", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's newest cache row that its observation could use within seven days."""
    shots = table(spark, sf_dir, "snapshots").select(F.col("page_id").alias("request_id"), url_digest(F.col("url")).alias("digest"), F.col("observed_at").alias("at"), "locale").distinct()
    return cache_asof(shots, _cache(spark, sf_dir), LIFETIME["page"]).select("request_id", F.date_format("cached_at", "yyyy-MM-dd HH:mm:ss").alias("cached"), "hit")


def cache_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `cache_lookup`, for rows of equal locale, null like null."""
    shots = table(spark, sf_dir, "snapshots").select(F.col("page_id").alias("request_id"), url_digest(F.col("url")).alias("digest"), F.col("observed_at").alias("at"), "locale").distinct()
    return cache_asof(shots, _cache(spark, sf_dir), LIFETIME["page"], locale=True).select("request_id", "hit")


def error_gate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with more than two failures since their last success, events of type error as failures."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "purchase").alias("ok"))
    return error_gate(e, 2, 30 * 86400)


def blockade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages off the hosts that are blocked on 2026-01-01: every third site, for a time that its id tells."""
    sites = table(spark, sf_dir, "sites")
    blocked = sites.select(F.col("host").alias("domain"), F.when(F.col("site_id") % 3 == 0, F.lit("2999-01-01 00:00:00")).otherwise("2025-01-01 00:00:00").cast("timestamp").alias("expire_at"))
    pages = table(spark, sf_dir, "formatted_pages").select("page_id", "url").distinct()
    return not_blocked(pages, blocked, F.lit("2026-01-01 00:00:00").cast("timestamp")).select("page_id").distinct()


def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots worth indexing."""
    shots = table(spark, sf_dir, "snapshots").withColumn("n", estimated_tokens(F.col("text")))
    return shots.filter(index_eligible(F.col("title"), F.col("is_intermediate"), F.col("status"), F.col("n"), F.col("elem_count"), F.col("traits"), F.col("html"))).select("page_id").distinct()


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page's path by its site's rules, which differ with the site's name and id."""
    pages = table(spark, sf_dir, "formatted_pages").select(F.col("page_id").alias("request_id"), site_of(F.col("url")).alias("origin"), F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1).alias("path"), F.lit("Reader").alias("agent")).distinct()
    lines = ["# rules", "Disallow: /", F.substr("host", F.lit(1), F.lit(3)), "\nAllow: /kelkel\nUser-agent: other\nDisallow: /\n\nUSER-AGENT: ", F.element_at(F.array(F.lit("*"), F.lit("reader"), F.lit("Other")), (F.col("site_id") % 3 + 1).cast("int")), "\nDisallow: /kel*1\nDisallow: /zim # old\nDisallow: /nor?\nDisallow: /va*-1*x\nDisallow: /", F.substr("host", F.lit(4), F.lit(3)), "\nAllow:\nDisallow: /"]
    body = F.concat(*(F.lit(x.replace("rules", "rules\n")) if isinstance(x, str) else x for x in lines))
    return robots_verdict(pages, table(spark, sf_dir, "sites").select(F.col("host").alias("origin"), body.alias("body")))


def status_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows each fetch."""
    shots = table(spark, sf_dir, "snapshots").select("page_id", "status", estimated_tokens(F.col("text")).alias("n"))
    return shots.select("page_id", next_action(F.col("status"), F.col("n")).alias("next_action")).distinct()


QUERIES = {
    "cache_latest": cache_latest, "cache_asof": cache_lookup, "cache_locale": cache_locale, "error_gate": error_gate_events, "blockade_antijoin": blockade, "index_eligibility": eligibility, "robots_verdict": robots, "next_action": status_actions,
}
_D = "md5(lower(case when url like '%#/%' then url else regexp_replace(url, '#.*$', '') end))"
_ASOF = f"""with req as (select distinct page_id as request_id, {_D} as digest, observed_at as req_at, locale from snapshots),
c as (select distinct digest, coerced, locale, created_at from page_cache),
best as (select request_id, max(struct_pack(a := c.created_at, b := c.coerced)) as m, max(req_at) as req_at from req left join c on req.digest = c.digest and c.created_at <= req.req_at <ON> group by request_id)
select request_id, <OUT> coalesce(m.b or m.a >= req_at - interval 7 day, false) as hit from best"""
_SITE = r"regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', '')"
ORACLE = {
    "cache_latest": "select digest, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') as created from page_cache group by digest",
    "cache_asof": _ASOF.replace("<ON>", "").replace("<OUT>", "strftime(m.a, '%Y-%m-%d %H:%M:%S') as cached,"),
    "cache_locale": _ASOF.replace("<ON>", "and c.locale is not distinct from req.locale").replace("<OUT>", ""),
    "error_gate": """with m as (select user_id, max(case when event_type = 'purchase' then ts end) as ok, max(ts) as now from events group by user_id)
select user_id as key, count(*) as n_errors from events join m using (user_id) where event_type <> 'purchase' and (ok is null or ts > ok) and ts >= now - interval 30 day group by user_id having count(*) > 2""",
    "blockade_antijoin": f"select distinct page_id from formatted_pages where {_SITE} not in (select host from sites where site_id % 3 = 0)",
    "index_eligibility": f"""select distinct page_id from snapshots where trim(coalesce(title, '')) <> '' and not (coalesce(elem_count, 0) > 0 and coalesce(is_intermediate, false))
  and (len(coalesce(traits, [])) > 0 or coalesce({TOKEN_SQL % "text"}, 0) >= 200 or (status = 200 and not coalesce(html like '%captcha%' or html like '%cf-turnstile%', false)))""",
    "next_action": f"select distinct page_id, case when status in (201, 202, 404, 405) then 'keep' when {TOKEN_SQL % 'text'} < 42 or status <> 200 then 'retry' else 'keep' end as next_action from snapshots",
    # the rules as rows, read in order
    "robots_verdict": rf"""with p as (select distinct page_id, {_SITE} as host, regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) as path from formatted_pages),
body as (select host, '# rules' || chr(10) || 'Disallow: /' || host[1:3] || chr(10) || 'Allow: /kelkel' || chr(10) || 'User-agent: other' || chr(10) || 'Disallow: /' || chr(10) || chr(10) || 'USER-AGENT: ' || (['*', 'reader', 'Other'])[site_id % 3 + 1]
  || chr(10) || 'Disallow: /kel*1' || chr(10) || 'Disallow: /zim # old' || chr(10) || 'Disallow: /nor?' || chr(10) || 'Disallow: /va*-1*x' || chr(10) || 'Disallow: /' || host[4:6] || chr(10) || 'Allow:' || chr(10) || 'Disallow: /' as body from sites),
rows as (select host, unnest(string_split(body, chr(10))) as line, unnest(range(0, len(string_split(body, chr(10))))) as n from body),
named as (select host, n, lower(trim(string_split(line, ':')[1])) as name, trim(regexp_extract(line, '^[^:]*:(.*)$', 1)) as value from rows where trim(line) <> '' and line not like '#%'),
ruled as (select *, last_value(case when name = 'user-agent' then lower(value) end ignore nulls) over (partition by host order by n) as agent from named),
hits as (select page_id, n, value = '' or name = 'allow' as verdict from p join ruled using (host) where name in ('allow', 'disallow') and (agent is null or agent in ('*', 'reader')) and
  case when value = '' then true when name = 'disallow' and contains(value, '*') then starts_with(path, string_split(value, '*')[1]) and ends_with(path, string_split(value, '*')[2]) else starts_with(path || '?', value) end)
select p.page_id as request_id, coalesce(arg_min(verdict, n), true) as allowed from p left join hits using (page_id) group by p.page_id""",
}
