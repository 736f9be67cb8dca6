"""Addresses and networks as bytes."""

from __future__ import annotations

import ipaddress

# Networks that aren't public.
NON_PUBLIC = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "240.0.0.0/4",
    "::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8", "::ffff:0:0/96",
]
_NETWORKS = [ipaddress.ip_network(n) for n in NON_PUBLIC]


def parse_ip(text: str | None) -> bytes | None:
    """4 or 16 bytes; None if it is no address."""
    try:
        return ipaddress.ip_address((text or "").strip("[]")).packed
    except ValueError:
        return None


def format_ip(packed: bytes | None) -> str | None:
    return str(ipaddress.ip_address(packed)) if packed is not None and len(packed) in (4, 16) else None


def in_cidr(text: str | None, cidr: str | None) -> bool | None:
    """Whether an address is in a network of the same family; None if either can't be read."""
    try:
        network = ipaddress.ip_network(cidr or "", strict=False)
        address = ipaddress.ip_address((text or "").strip("[]"))
    except ValueError:
        return None
    return address.version == network.version and address in network


def is_non_public(text: str | None) -> bool | None:
    """Whether an address lies in a network that isn't public, mapped IPv4 addresses as themselves."""
    try:
        address = ipaddress.ip_address((text or "").strip("[]"))
    except ValueError:
        return None
    if address.version == 6 and address.ipv4_mapped:
        address = address.ipv4_mapped
    return any(address in n for n in _NETWORKS if n.version == address.version)
