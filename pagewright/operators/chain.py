"""The search and fetch chain on tables: provider order, qualified results, query cache, projections, temporal blobs, ranges of addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.urls import ipv4_number
from pagewright.storage import table

#: Bits of an address that a bucket of `range_lookup` leaves open.
BUCKET_BITS = 20
# Fields that make a result worth showing, and the fields an entry keeps.
QUALIFYING = ["content", "snippet", "text", "html", "description", "title", "url", "link"]


def provider_order(preference: Column, custom: bool = False, keyed: bool = True) -> Column:
    """Providers to ask in turn. custom: a search engine of one's own is set up; keyed: a key for the keyed providers is there."""
    own = ["custom"] if custom else []
    key = lambda name: [name] if keyed else []
    array = lambda names: F.array(*map(F.lit, [*own, *names]))
    return (
        F.when(preference == "bing", array([*key("keyed-bing"), "bing"])).when(preference == "google", array(["google", *key("keyed-google"), "common-google"]))
        .otherwise(array([*key("keyed-google"), "ddg", "google", "bing", "common-google"]))
    )


def qualified(columns: list[str]) -> Column:
    """Whether one of the qualifying fields among the columns holds something."""
    found = [F.coalesce(F.col(c), F.lit("")) != "" for c in QUALIFYING if c in columns]
    out = F.lit(False)
    for f in found:
        out = out | f
    return out


def entry_page(entries: DataFrame) -> DataFrame:
    """Search entries as the pages they stand for: title, url and description, with image, source and date where there are any."""
    keep = [c for c in ("image_url", "source", "date") if c in entries.columns]
    return entries.select("entry_id", "title", F.col("link").alias("url"), F.col("snippet").alias("description"), *keep)


def query_cache(entries: DataFrame, now: Column, valid_seconds: int = 3600, keys: tuple[str, ...] = ("query_digest", "variant")) -> DataFrame:
    """The rows of each query's newest fetch that isn't stale at `now` and has a link; stale queries have none.

    The newest time is a maximum that is added up before the shuffle; null keys are queries of their own.
    """
    newest = entries.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("fetched_at").alias("_at"))
    fresh = newest.filter(F.unix_micros(F.col("_at").cast("timestamp")) >= F.unix_micros(now.cast("timestamp")) - valid_seconds * 1_000_000)
    on = F.col("fetched_at") == F.col("_at")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return entries.filter(F.coalesce("link", F.lit("")) != "").join(fresh, on, "left_semi")


def is_temporal(blob_url: Column) -> Column:
    """Whether a cached page lies in a blob whose address holds a query, which passes away."""
    return F.coalesce(F.regexp_extract(F.regexp_replace(blob_url, "#.*$", ""), r"\?(.+)$", 1), F.lit("")) != ""


def range_lookup(points: DataFrame, ranges: DataFrame, key: str, number: str = "number", bits: int = BUCKET_BITS) -> DataFrame:
    """`points` (with a unique `key`) and the columns of the range (first, last, ...) that holds `number`, null where none does; of several, the narrowest.

    A range is repeated for each bucket of 2^bits numbers that it touches, so that the join is one of equal buckets with a condition,
    and never of all points with all ranges. Wide ranges touch many buckets: choose bits by the widest.
    """
    others = [c for c in ranges.columns if c not in ("first", "last")]
    buckets = ranges.withColumn("_bucket", F.explode(F.sequence(F.shiftright("first", bits), F.shiftright("last", bits))))
    held = buckets.select("_bucket", F.col("first").alias("_first"), F.col("last").alias("_last"), F.struct(*others).alias("_range"))
    found = points.select(key, number, F.shiftright(number, bits).alias("_bucket")).join(held, "_bucket").filter(F.col(number).between(F.col("_first"), F.col("_last")))
    best = found.groupBy(F.col(key).alias("_key")).agg(F.min_by("_range", F.struct(F.col("_last") - F.col("_first"), "_range")).alias("_r"))
    return points.join(best, F.col(key) == F.col("_key"), "left").select(*points.columns, *(F.col("_r")[c].alias(c) for c in others))


def not_in_blocked_systems(points: DataFrame, ranges: DataFrame, blockades: DataFrame, now: Column, key: str, number: str = "number") -> DataFrame:
    """Points whose range's `asn` isn't blocked at `now`. ranges: first, last, asn; blockades: asn, expire_at."""
    blocked = blockades.filter(F.col("expire_at") > now).select(F.col("asn").alias("_asn")).distinct()
    return range_lookup(points, ranges, key, number).join(blocked, F.col("asn") == F.col("_asn"), "left_anti")


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order for each row's preference, by its rank."""
    rows = table(spark, sf_dir, "serp_entries").select("entry_id", "rank").distinct()
    preference = F.element_at(F.array(F.lit("bing"), F.lit("google"), F.lit(None).cast("string")), F.col("rank") % 3 + 1)
    return rows.select("entry_id", F.array_join(provider_order(preference), ",").alias("providers"))


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every qualified entry as a page."""
    entries = table(spark, sf_dir, "serp_entries").drop("fetched_at").dropDuplicates(["entry_id"])
    return entry_page(entries.filter(qualified(["snippet", "title", "link"]))).select("entry_id", F.md5(F.concat_ws("|", "title", "url", "description", "image_url", "source", "date")).alias("page_md5"))


def cached_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a query would be answered from at the time of the last fetch, if a month is fresh enough."""
    entries = table(spark, sf_dir, "serp_entries").select("entry_id", "query_digest", "variant", "link", "fetched_at").distinct()
    now = entries.agg(F.max("fetched_at")).first()[0]
    return query_cache(entries, F.lit(now), 30 * 86400).select("entry_id").distinct()


def lasting_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of cached pages that don't lie behind a query."""
    return table(spark, sf_dir, "page_cache").filter(~is_temporal(F.col("url"))).select("digest").distinct()


def _systems(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Addresses made of customers' ids, and a range for each supplier and nation, which overlap."""
    ip = F.concat_ws(".", F.pmod(F.col("c_custkey") * 3, F.lit(256)), F.pmod(F.col("c_custkey") * 7, F.lit(256)), F.pmod(F.col("c_custkey") * 13, F.lit(256)), F.lit("9"))
    points = table(spark, sf_dir, "customer").select("c_custkey", ipv4_number(ip).alias("number"))
    narrow = table(spark, sf_dir, "supplier").select((F.col("s_suppkey").cast("long") * 9_000_000).alias("first"), F.col("s_suppkey").alias("asn"), F.lit(5_000_000).alias("width"))
    wide = table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") * 150_000_000).alias("first"), (F.col("n_nationkey") + 100_000).alias("asn"), F.lit(120_000_000).alias("width"))
    both = narrow.select(F.col("first").cast("long").alias("first"), F.col("asn").cast("long").alias("asn"), "width").unionByName(wide.select(F.col("first").cast("long").alias("first"), F.col("asn").cast("long").alias("asn"), "width"))
    return points, both.filter("first < 4294967296").select("first", (F.col("first") + F.col("width") - 1).alias("last"), "asn")


def address_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The system of the narrowest range of every address, -1 where there is none."""
    points, ranges = _systems(spark, sf_dir)
    return range_lookup(points, ranges, "c_custkey").select("c_custkey", F.coalesce("asn", F.lit(-1)).alias("asn"))


def open_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses outside the blocked systems: every fifth one is blocked for good, every other one was until 2020."""
    points, ranges = _systems(spark, sf_dir)
    until = F.when(F.col("asn") % 5 == 0, F.lit("2999-01-01")).otherwise("2020-01-01").cast("timestamp")
    return not_in_blocked_systems(points, ranges, ranges.select("asn", until.alias("expire_at")), F.lit("2026-01-01").cast("timestamp"), "c_custkey").select("c_custkey")


QUERIES = {
    "provider_order": providers, "result_pages": result_pages, "query_cache": cached_queries, "temporal_blob": lasting_cache, "address_systems": address_systems, "asn_blockade": open_addresses,
}
_SYSTEMS = """p as (select c_custkey, (c_custkey * 3 % 256) * 16777216 + (c_custkey * 7 % 256) * 65536 + (c_custkey * 13 % 256) * 256 + 9 as number from customer),
r as (select * from (select s_suppkey * 9000000::bigint as first, s_suppkey * 9000000::bigint + 4999999 as last, s_suppkey::bigint as asn from supplier union all select n_nationkey * 150000000::bigint, n_nationkey * 150000000::bigint + 119999999, n_nationkey + 100000 from nation) where first < 4294967296),
a as (select c_custkey, arg_min(asn, struct_pack(a := last - first, b := asn)) as asn from p left join r on number between first and last group by c_custkey)"""
ORACLE = {
    "provider_order": "select distinct entry_id, case rank % 3 when 0 then 'keyed-bing,bing' when 1 then 'google,keyed-google,common-google' else 'keyed-google,ddg,google,bing,common-google' end as providers from serp_entries",
    "result_pages": "select distinct entry_id, md5(concat_ws('|', title, link, snippet, image_url, source, date)) as page_md5 from serp_entries where coalesce(snippet, '') <> '' or coalesce(title, '') <> '' or coalesce(link, '') <> ''",
    "query_cache": """with n as (select query_digest as q, variant as v, max(fetched_at) as newest from serp_entries group by 1, 2), now as (select max(fetched_at) as t from serp_entries)
select distinct entry_id from serp_entries join n on query_digest = q and variant is not distinct from v and fetched_at = newest, now where newest >= t - interval 30 day and coalesce(link, '') <> ''""",
    "temporal_blob": "select distinct digest from page_cache where not regexp_matches(regexp_replace(url, '#.*$', ''), '\\?.')",
    "address_systems": f"with {_SYSTEMS} select c_custkey, coalesce(asn, -1) as asn from a",
    "asn_blockade": f"with {_SYSTEMS} select c_custkey from a where asn is null or asn % 5 <> 0",
}
