"""Resolving and serialising URLs as browsers do."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}  # fixed values: default ports
_SAFE = "!#$%&'()*+,-./:;=?@[]_~|^"


def resolve(href: str | None, base: str | None) -> str | None:
    """Absolute, serialised URL of `href`; None if it can't be read."""
    if href is None:
        return None
    href = re.sub(r"[\t\n\r]", "", href.strip())
    scheme = re.match(r"([a-zA-Z][a-zA-Z0-9+.\-]*):", href)
    if scheme and scheme[1].lower() not in _PORTS and scheme[1].lower() != "file":
        return scheme[1].lower() + href[scheme.end(1) :]
    try:
        special = (scheme[1] if scheme else (urlsplit(base or "").scheme)).lower() in _PORTS
        joined = urljoin(base or "", href.replace("\\", "/") if special else href)
        u = urlsplit(joined)
        if not u.scheme:
            return None
        if u.scheme in _PORTS:
            if not u.hostname:
                return None
            host = u.hostname
            if not host.isascii():
                host = host.encode("idna").decode("ascii")
            if ":" in host:
                host = f"[{host}]"
            elif re.search(r"[\s<>\"`{}|\\^%]", host):
                return None
            port = u.port
            user = u.netloc.rpartition("@")[0]
            netloc = (f"{user}@" if user else "") + host + (f":{port}" if port is not None and port != _PORTS[u.scheme] else "")
        else:
            netloc = u.netloc
    except (ValueError, UnicodeError):
        return None
    path = _dots(u.path) if u.scheme in _PORTS else u.path
    return urlunsplit((u.scheme, netloc, quote(path or ("/" if u.scheme in _PORTS else ""), safe=_SAFE.replace("#", "").replace("?", "")), quote(u.query, safe=_SAFE + "`{}"), quote(u.fragment, safe=_SAFE + "{}")))


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        if p.lower() in ("..", ".%2e", "%2e.", "%2e%2e"):
            if len(out) > 1:
                out.pop()
            if last:
                out.append("")
        elif p.lower() in (".", "%2e"):
            if last:
                out.append("")
        else:
            out.append(p)
    return "/".join(out)


#: Second-level labels under which names are registered, besides country codes. Fixed values.
_SECOND = frozenset("co com org net gov edu ac or ne go gob govt".split())


def registrable_domain(host: str) -> str:
    """The part of a host that is registered: two labels, or three below a short list of second-level labels."""
    labels = host.lower().strip(".").split(".")
    if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in _SECOND:
        return ".".join(labels[-3:])
    return ".".join(labels[-2:])


def normalise(url: str, allow_private: bool = False) -> tuple[str | None, str | None]:
    """(URL, error): tracking parameters and text fragments dropped; only http, https and blob; no private addresses."""
    from pagewright.kernel.ip import is_non_public, parse_ip

    fixed = resolve(url, None)
    if fixed is None:
        return None, "invalid url"
    u = urlsplit(fixed)
    if u.scheme not in ("http", "https", "blob"):
        return None, f"protocol {u.scheme} is not supported"
    if u.scheme == "blob":
        return fixed, None
    host = u.hostname or ""
    if parse_ip(host) is not None and is_non_public(host):
        return None, "private address"
    if not allow_private and (host == "localhost" or host.endswith(".localhost")):
        return None, "private address"
    query = "&".join(p for p in u.query.split("&") if p and not p.lower().startswith("utm_"))
    return urlunsplit((u.scheme, u.netloc, u.path, query, re.sub(r":~:.*$", "", u.fragment))), None
