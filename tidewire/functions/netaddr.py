"""IP, CIDR and MAC arithmetic as column expressions; IPv6 through one Arrow-batched function."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

V4_PATTERN = r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"

# IPv4 ranges by kind.
V4_KINDS = {
    "unspecified": ["0.0.0.0/32"],
    "loopback": ["127.0.0.0/8"],
    "link_local": ["169.254.0.0/16"],
    "multicast": ["224.0.0.0/4"],
    "private": ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10"],
}


def v4_to_long(ip: Column) -> Column:
    """The address as a number; null where the text is no IPv4 address."""
    octets = [F.split_part(ip, F.lit("."), F.lit(i)).try_cast("bigint") for i in range(1, 5)]
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(ip.rlike(V4_PATTERN), value)


def long_to_v4(value: Column) -> Column:
    parts = [F.shiftright(value, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *parts)


def v4_range(prefix: str) -> tuple[int, int]:
    """Lowest and highest address of a CIDR prefix. A bare address is a prefix of full length."""
    net = ipaddress.ip_network(prefix, strict=False)
    if net.version != 4:
        raise ValueError(f"{prefix} is no IPv4 prefix")
    return int(net.network_address), int(net.broadcast_address)


def in_v4_prefix(value: Column, prefix: str) -> Column:
    lo, hi = v4_range(prefix)
    return value.between(lo, hi)


def v4_kind(value: Column) -> Column:
    """unspecified, loopback, link_local, multicast, private or global."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for kind, prefixes in V4_KINDS.items():
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | in_v4_prefix(value, p)
        out = out.when(hit, kind)
    return out.otherwise("global")


def is_internal(value: Column, prefixes: list[str] | None = None) -> Column:
    """Private, link-local, loopback, or within one of the given prefixes."""
    hit = v4_kind(value).isin("private", "link_local", "loopback")
    for p in prefixes or []:
        hit = hit | in_v4_prefix(value, p)
    return hit


def canonical_mac(mac: Column) -> Column:
    """Twelve hex digits with any of the usual separators, as lower-case pairs with colons; null otherwise."""
    digits = F.lower(F.regexp_replace(mac, r"[:\-.]", ""))
    return F.when(digits.rlike("^[0-9a-f]{12}$"), F.regexp_replace(F.regexp_replace(digits, "(..)", "$1:"), ":$", ""))


def _pack(ips: pd.Series) -> pd.Series:
    def one(text):
        try:
            address = ipaddress.ip_address(text)
        except ValueError:
            return None
        if address.version == 6 and address.ipv4_mapped:
            address = address.ipv4_mapped
        return (b"\0" * 10 + b"\xff\xff" + address.packed) if address.version == 4 else address.packed

    return ips.map(one)


def packed_address(ip: Column) -> Column:
    """Sixteen bytes in which IPv4 is mapped, so that unsigned byte order is address order; null if no address."""
    return F.pandas_udf(_pack, BinaryType())(ip)


def packed_range(prefix: str) -> tuple[bytes, bytes]:
    net = ipaddress.ip_network(prefix, strict=False)
    pad = b"\0" * 10 + b"\xff\xff" if net.version == 4 else b""
    return pad + net.network_address.packed, pad + net.broadcast_address.packed


def in_prefix(ip: Column, prefix: str) -> Column:
    """Whether a textual address lies in an IPv4 or IPv6 prefix. IPv4 stays in JVM expressions."""
    if ipaddress.ip_network(prefix, strict=False).version == 4:
        return F.coalesce(in_v4_prefix(v4_to_long(ip), prefix), F.lit(False))
    lo, hi = packed_range(prefix)
    packed = packed_address(ip)
    return F.coalesce((packed >= F.lit(bytearray(lo))) & (packed <= F.lit(bytearray(hi))), F.lit(False))
