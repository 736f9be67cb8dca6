"""Column expressions on URLs and addresses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.kernel import ip as ip_kernel
from pagewright.kernel import url as url_kernel
from pagewright.kernel.render import VIDEO_HOSTS


def attempt_url_fix(url: Column, own_host: str | None = None) -> Column:
    """Without the service's own host in front, and with repeated schemes collapsed to the last."""
    out = url
    if own_host:
        out = F.regexp_replace(out, rf"(?i)^(?:https?://)?{own_host.replace('.', chr(92) + '.')}/", "")
    return F.regexp_replace(out, r"^(?:(?:view-source:)?https?://+)+(?=(?:view-source:)?https?://)", "")


def with_scheme(url: Column) -> Column:
    """`https://` in front of an address without scheme."""
    return F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), url).otherwise(F.concat(F.lit("https://"), F.regexp_replace(url, "^//", "")))


def url_digest(url: Column) -> Column:
    """md5 of the lower-case address without its fragment, unless that is a route (`#/...`)."""
    return F.md5(F.lower(F.when(url.rlike("#/"), url).otherwise(F.regexp_replace(url, "#.*$", ""))))


def profile_digest(url: Column) -> Column:
    """md5 of the origin and the parent path."""
    bare = F.regexp_replace(url, "[?#].*$", "")
    return F.md5(F.lower(F.regexp_replace(bare, r"(?<=[^/:])/[^/]*$", "")))


def search_target(link: Column) -> Column:
    """The page behind a search engine's redirect: uddg=, u=a1<base64> or /url?q=."""
    duck = F.regexp_extract(link, r"[?&]uddg=([^&]+)", 1)
    bing = F.regexp_extract(link, r"[?&]u=a1([A-Za-z0-9_\-]+)", 1)
    google = F.regexp_extract(link, r"/url\?(?:.*&)?(?:q|url)=([^&]+)", 1)
    decode = lambda c: F.try_url_decode(F.regexp_replace(c, r"\+", "%2B"))
    return F.when(duck != "", decode(duck)).when(bing != "", F.unbase64(F.translate(bing, "-_", "+/")).cast("string")).when(google != "", decode(google)).otherwise(link)


def decode_component(text: Column) -> Column:
    """Percent-decoded; null where it can't be."""
    return F.try_url_decode(F.regexp_replace(text, r"\+", "%2B"))


def video_canonical(url: Column) -> Column:
    """The page of an embedded video, else null."""
    full = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    out = F.lit(None).cast("string")
    for pattern, page in reversed(VIDEO_HOSTS):
        found = F.regexp_extract(full, pattern.pattern, 1)
        before, after = page.split("{}")
        out = F.when(found != "", F.concat(F.lit(before), found, F.lit(after))).otherwise(out)
    return out


def ipv4_number(text: Column) -> Column:
    """An IPv4 address as a number, else null."""
    part = lambda i: F.regexp_extract(text, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("long")
    number = part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4)
    return F.when(F.greatest(*(part(i) for i in range(1, 5))) <= 255, number)


def ipv4_in_cidr(text: Column, cidr: Column) -> Column:
    """Whether an IPv4 address is in a network, by shifted numbers that Catalyst can fold and compare."""
    bits = (F.lit(32) - F.regexp_extract(cidr, r"/(\d+)$", 1).try_cast("int"))
    net = ipv4_number(F.regexp_replace(cidr, r"/\d+$", ""))
    return F.floor(ipv4_number(text) / F.pow(F.lit(2), bits)) == F.floor(net / F.pow(F.lit(2), bits))


def non_public_ipv4(text: Column) -> Column:
    """Whether an IPv4 address lies in a network that isn't public; null for other texts."""
    import ipaddress

    number = ipv4_number(text)
    ranges = [ipaddress.ip_network(n) for n in ip_kernel.NON_PUBLIC if ":" not in n]
    out = F.lit(False)
    for n in ranges:
        out = out | number.between(int(n.network_address), int(n.broadcast_address))
    return F.when(number.isNotNull(), out)


@F.pandas_udf(T.BooleanType())
def non_public_ip(text: pd.Series) -> pd.Series:
    return pd.Series([ip_kernel.is_non_public(t) for t in text], dtype="boolean")


@F.pandas_udf(T.BooleanType())
def in_cidr(text: pd.Series, cidr: pd.Series) -> pd.Series:
    return pd.Series([ip_kernel.in_cidr(t, c) for t, c in zip(text, cidr, strict=True)], dtype="boolean")


@F.pandas_udf(T.BinaryType())
def ip_bytes(text: pd.Series) -> pd.Series:
    return pd.Series([ip_kernel.parse_ip(t) for t in text], dtype=object)


@F.pandas_udf(T.StringType())
def ip_text(packed: pd.Series) -> pd.Series:
    return pd.Series([ip_kernel.format_ip(p) for p in packed], dtype=object)


@F.pandas_udf(T.StringType())
def resolve_url(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([url_kernel.resolve(h, b) for h, b in zip(href, base, strict=True)], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("url", T.StringType()), T.StructField("error", T.StringType())]))
def normalise_url(url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([url_kernel.normalise(u) if u else (None, "invalid url") for u in url], columns=["url", "error"], dtype=object)


def registrable_domain(host: Column) -> Column:
    """The registered part of a host."""
    labels = F.split(F.lower(host), r"\.")
    three = (F.size(labels) > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, -2).isin(*sorted(url_kernel._SECOND))
    return F.array_join(F.slice(labels, -F.least(F.size(labels), F.when(three, 3).otherwise(2)), 3), ".")
